"""Field extraction from mail text as JVM column expressions.

All patterns run as Java regular expressions inside whole-stage codegen; no
Python per row. ``(?U)`` turns on Unicode classes so ``\\d``, ``\\s`` and ``\\b``
behave like Python's ``re`` on text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: extraction patterns of the data model ---------------------
# Court case number: long form with optional year and court parts, or 20 digits.
CASE_NUMBER_RE = r"\d{7}-\d{2}(?:\.\d{4})?\.\d(?:\.\d{2})?\.\d{4}|\d{20}"
# Fallback case number: first run of 6 to 25 digits.
DIGIT_RUN_RE = r"\d{6,25}"
# Order number after the OPAJ marker (hyphen, en dash, colon, slash, space).
ORDER_NUMBER_RE = r"OPAJ[-–:/\s]*([0-9]+)"
# Identifier: FNDA or DILA, one optional separator, six or more digits.
IDENTIFIER_RE = r"\b(FNDA|DILA)[-–:/\s]?(\d{6,})\b"
# Final-status phrases searched in the upper-cased subject; the last one wins.
FINAL_STATUS_RE = r"(RESPOSTA FINAL|RESPOSTA PARCIAL|DILAÇÃO|RESPOSTA MONITORAMENTO)"
# Strict forms: full case number with 1-2 digit court parts; 7-digit word.
STRICT_CASE_NUMBER_RE = r"\d{7}-\d{2}\.\d{4}\.\d{1,2}\.\d{1,2}\.\d{4}"
STRICT_ORDER_NUMBER_RE = r"\b\d{7}\b"
# Branch and court inside a full case number.
COURT_RE = r"^\d{7}-\d{2}\.\d{4}\.(\d\.\d{2})\.\d{4}$"
# Date header layout accepted by the capture ("Mon, 01 Jan 2024 10:00:00 +0000").
DATE_HEADER_RE = (r"(?i)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{1,2} [A-Z]{3} \d{4} \d{1,2}:\d{2}:\d{2} "
                  r"(?:[+-]\d{2}:?\d{2}|Z)$")
DATE_HEADER_CUT = 31
# -----------------------------------------------------------------------------

U = "(?U)"
IU = "(?iU)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mail_text(subject="assunto", body="corpo_email") -> Column:
    """``subject + ' ' + body`` with NULLs read as empty strings."""
    return F.concat(F.coalesce(_col(subject), F.lit("")), F.lit(" "),
                    F.coalesce(_col(body), F.lit("")))


def case_number(text) -> Column:
    """first long-form case number, else first 6-25 digit run, else NULL."""
    t = _col(text)
    return F.coalesce(F.regexp_substr(t, F.lit(U + CASE_NUMBER_RE)),
                      F.regexp_substr(t, F.lit(U + DIGIT_RUN_RE)))


def court(number) -> Column:
    """Branch and court (``8.26``) of a case number, written out or as 20 digits; else NULL."""
    n = _col(number)
    long, plain = F.regexp_extract(n, COURT_RE, 1), F.regexp_extract(n, r"^\d{13}(\d)\d{6}$", 1)
    return F.coalesce(F.nullif(long, F.lit("")),
                      F.when(plain != "", F.concat(plain, F.lit("."), F.substring(n, 15, 2))))


def case_kind(text) -> Column:
    """'CNJ' when the long form matched, 'ADMINISTRATIVO' for digits only."""
    t = _col(text)
    return (F.when(F.regexp_substr(t, F.lit(U + CASE_NUMBER_RE)).isNotNull(), F.lit("CNJ"))
            .when(F.regexp_substr(t, F.lit(U + DIGIT_RUN_RE)).isNotNull(),
                  F.lit("ADMINISTRATIVO")))


def order_number(text) -> Column:
    """digits after the OPAJ marker, case-insensitive; NULL when absent."""
    return F.nullif(F.regexp_extract(_col(text), IU + ORDER_NUMBER_RE, 1), F.lit(""))


def identifier(text) -> Column:
    """``PREFIX-digits`` with the prefix upper-cased; NULL when absent."""
    t = _col(text)
    prefix = F.regexp_extract(t, IU + IDENTIFIER_RE, 1)
    digits = F.regexp_extract(t, IU + IDENTIFIER_RE, 2)
    return F.when(prefix != "", F.concat(F.upper(prefix), F.lit("-"), digits))


def final_status(subject) -> Column:
    """the last status phrase found in the upper-cased subject."""
    found = F.regexp_extract_all(F.upper(_col(subject)), F.lit(IU + FINAL_STATUS_RE), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def strict_case_number(text) -> Column:
    """strict case number, '' when absent."""
    return F.regexp_extract(F.coalesce(_col(text), F.lit("")), U + STRICT_CASE_NUMBER_RE, 0)


def strict_order_number(text) -> Column:
    """first standalone 7-digit word, '' when absent."""
    return F.regexp_extract(F.coalesce(_col(text), F.lit("")), U + STRICT_ORDER_NUMBER_RE, 0)


def content_hash(content) -> Column:
    """F8: SHA-256 hex of bytes or UTF-8 text; NULL stays NULL."""
    return F.sha2(_col(content), 256)


def extract_fields(df, text=None, prefix: str = ""):
    """Add ``processo``, ``opaj``, ``identificador`` from subject and body."""
    t = text if text is not None else mail_text()
    return (df.withColumn(prefix + "processo", case_number(t))
              .withColumn(prefix + "opaj", order_number(t))
              .withColumn(prefix + "identificador", identifier(t)))


def subject_refs(df, subject: str = "assunto"):
    """The subject 5-tuple: case number, order number, identifier, status, kind."""
    s = F.col(subject)
    return df.select("*",
                     case_number(s).alias("processo"), order_number(s).alias("opaj"),
                     identifier(s).alias("identificador"),
                     final_status(s).alias("status_final"), case_kind(s).alias("tipo_processo"))


def received_time(header, fallback) -> Column:
    """parse a mail date header, else the fallback timestamp.

    The header is cut to its first 31 characters and must then be exactly
    ``Www, d Mon yyyy HH:mm:ss zone``, with a day's name and a zone as ``+hhmm``,
    ``+hh:mm`` or ``Z``; anything else falls back. The instant is returned as a UTC wall-clock ``TIMESTAMP_NTZ`` (session zone UTC).
    """
    cut = F.substring(_col(header), 1, DATE_HEADER_CUT)
    no_weekday = F.regexp_replace(cut, r"^[A-Za-z]{3}, ", "")
    no_weekday = F.regexp_replace(F.regexp_replace(no_weekday, r"(\d{2}):(\d{2})$", "$1$2"), r"(?i)Z$", "+0000")
    no_weekday = F.concat(F.regexp_extract(no_weekday, r"^(\d+ )", 1), F.initcap(F.regexp_extract(no_weekday, r"^\d+ (\w{3})", 1)),
                          F.regexp_extract(no_weekday, r"^\d+ \w{3}(.*)$", 1))
    parsed = F.try_to_timestamp(no_weekday, F.lit("d MMM yyyy H:mm:ss Z"))
    ok = cut.rlike(DATE_HEADER_RE)
    # The session zone is UTC (see session.BASE_CONF), so the cast yields UTC.
    return F.coalesce(F.when(ok, parsed.cast("timestamp_ntz")), _col(fallback))
