"""Mail capture as a batch job.

Input is a DataFrame of landed messages -- one row per message with a
sequence number (mailbox order), raw ``From``, message id, body, received
time -- plus a DataFrame of attachment parts keyed by the same sequence.
The original pass handled one message at a time; here every rule is a column
or a join, and each message gets exactly one outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdict import strip_text
from .upsert import first_per_key

# --- Fixed values: capture outcomes and quality messages ---------------------
NO_ATTACHMENT = "sem_anexo"
BAD_BODY = "fora_do_padrao"
NO_ATTACHMENT_MSG = "E-mail sem anexo. Não é possível realizar análise completa."
BAD_BODY_MSG = "Corpo da mensagem está vazio ou fora do padrão esperado."
MIN_BODY_CHARS = 20
OUTCOME_SAVED = "salvo"
OUTCOME_DUPLICATE = "duplicado"
OUTCOME_IGNORED = "ignorado"
OUTCOME_FAILED = "falha"
# Parts of a From header that hold no address: a quoted name, a comment.
QUOTED_NAME_RE = r'"(?:[^"\\]|\\.)*"(?!@)'
COMMENT_RE = r"\([^()]*\)"
# -----------------------------------------------------------------------------


def address_part(from_header) -> Column:
    """The address of a ``From`` header: inside ``<...>`` when present, else
    the first address of the header without its comments.

    Quoted display names and comments in parentheses (one inside another at
    most) are no part of an address, whatever signs they hold; a quoted local
    part (``"a b"@c``) is.
    """
    h = F.col(from_header) if isinstance(from_header, str) else from_header
    bare = F.regexp_replace(h, QUOTED_NAME_RE, " ")
    for _ in range(2):
        bare = F.regexp_replace(bare, COMMENT_RE, " ")
    inside = F.nullif(F.trim(F.regexp_extract(bare, r"<([^<>]*)>", 1)), F.lit(""))
    return F.coalesce(inside, F.trim(F.regexp_extract(bare, r'^((?:"[^"]*"|[^,"])*)', 1)))


def sender_filter(landed: DataFrame, address: str, col: str = "remetente") -> DataFrame:
    """Keep messages whose sender address equals ``address`` (any case)."""
    return landed.filter(F.lower(address_part(col)) == F.lit(address.lower()))


def identified(landed: DataFrame) -> DataFrame:
    """a message without an id gets one made from its content.

    Messages without an id that agree in sender, subject, time and body are
    copies; all others stay apart.
    """
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
               for c in ("remetente", "assunto", "recebido_em", "corpo_email") if c in landed.columns]
    made = F.concat(F.lit("<hash-"), F.sha2(F.concat_ws("\x1f", *content), 256), F.lit(">"))
    return landed.withColumn("message_id", F.coalesce(F.col("message_id"), made))


def message_keys(landed: DataFrame, *cols: str) -> DataFrame:
    """``message_id`` (made where there is none), ``seq`` and ``cols`` of landed messages.

    Bodies are read for messages without an id alone: a scan of its own, to
    which the test for null is pushed, so files whose messages all have ids
    are left out of it by their statistics.
    """
    own = landed.where(F.col("message_id").isNotNull()).select("message_id", "seq", *cols)
    made = identified(landed.where(F.col("message_id").isNull())).select("message_id", "seq", *cols)
    return own.unionByName(made)


def new_keys(landed: DataFrame, existing: DataFrame, address: str) -> DataFrame:
    """``message_id, seq`` of the messages that ``new_messages`` gives, without their bodies."""
    first = (message_keys(sender_filter(landed, address))
             .groupBy("message_id").agg(F.min("seq").alias("seq")))
    return first.join(existing.select("message_id").distinct(), "message_id", "left_anti")


def new_messages(landed: DataFrame, existing: DataFrame, address: str) -> DataFrame:
    """J7 + N1: accepted messages not yet stored, first occurrence per id.

    Messages without an id are told apart by content (``identified``).
    The first occurrence per ``message_id`` is an aggregate (min over seq), so
    a message id repeated across a third of the mailbox is reduced map-side.
    ``remetente`` becomes the bare address, the body is stripped.
    """
    accepted = sender_filter(identified(landed), address)
    accepted = accepted.withColumn("remetente", address_part("remetente")) \
                       .withColumn("corpo_email", strip_text("corpo_email"))
    first = first_per_key(accepted, "message_id", [F.col("seq")])
    return first.join(existing.select("message_id").distinct(), "message_id", "left_anti")


def mail_key() -> Column:
    """128-bit key of a mail, the same in every run and in every table it is stored in."""
    return F.md5(F.col("message_id").cast("binary"))


def keyed_emails(new: DataFrame) -> DataFrame:
    """Stored mail rows with a stable key derived from the message id
    (no round trip to a sequence; re-running gives the same keys)."""
    return new.withColumn("id_email", mail_key())


def stored_attachments(new: DataFrame, parts: DataFrame) -> DataFrame:
    """The attachment rows of new messages (``new_keys`` will do); empty parts are skipped."""
    p = parts.filter(F.col("tamanho") > 0)
    return new.select("seq", "message_id", mail_key().alias("id_email")).join(p, "seq", "inner")


def quality_failures(new: DataFrame, parts: DataFrame) -> DataFrame:
    """One quality row per new message that fails, attachment test first.

    No stored attachment -> ``sem_anexo``; else a NULL body or a stripped body
    shorter than 20 characters -> ``fora_do_padrao``.
    """
    counts = (parts.filter(F.col("tamanho") > 0).groupBy("seq")
              .agg(F.count(F.lit(1)).alias("n_anexos_salvos")))
    m = new.join(counts, "seq", "left").withColumn(
        "n_anexos_salvos", F.coalesce(F.col("n_anexos_salvos"), F.lit(0)))
    body = F.col("corpo_email")
    status = (F.when(F.col("n_anexos_salvos") == 0, F.lit(NO_ATTACHMENT))
              .when(body.isNull() | (F.length(strip_text(body)) < MIN_BODY_CHARS),
                    F.lit(BAD_BODY)))
    msg = F.when(status == NO_ATTACHMENT, F.lit(NO_ATTACHMENT_MSG)).otherwise(F.lit(BAD_BODY_MSG))
    out = m.withColumn("status", status).filter(F.col("status").isNotNull())
    return out.select("seq", "message_id", mail_key().alias("id_email"),
                      F.col("status").alias("tipo_resposta"), "status",
                      F.lit("erro").alias("status_validacao"), F.lit(False).alias("validado"),
                      F.array(msg).alias("erros"),
                      F.col("recebido_em").alias("data_chegada"))


def outcomes(landed: DataFrame, existing: DataFrame, address: str,
             parse_error: str | None = None) -> DataFrame:
    """Per-message outcome: ignorado (sender), falha (parse error), duplicado
    (id stored before, or seen earlier in the pass), salvo."""
    keys = message_keys(landed, "remetente", *([parse_error] if parse_error else []))
    parsed = keys.where(F.col(parse_error).isNull()) if parse_error else keys
    firsts = sender_filter(parsed, address).groupBy("message_id").agg(F.min("seq").alias("_first"))
    known = existing.select("message_id").distinct().withColumn("_known", F.lit(True))
    m = keys.join(firsts, "message_id", "left").join(known, "message_id", "left")
    accepted = F.lower(address_part("remetente")) == F.lit(address.lower())
    failed = F.col(parse_error).isNotNull() if parse_error else F.lit(False)
    outcome = (F.when(failed, F.lit(OUTCOME_FAILED))
               .when(~F.coalesce(accepted, F.lit(False)), F.lit(OUTCOME_IGNORED))
               .when(F.col("_known") | (F.col("seq") != F.col("_first")), F.lit(OUTCOME_DUPLICATE))
               .otherwise(F.lit(OUTCOME_SAVED)))
    return m.select("seq", "message_id", outcome.alias("resultado"))


def summary(landed: DataFrame, existing: DataFrame, address: str,
            parse_error: str | None = None) -> DataFrame:
    """A4: saved, duplicates, failures (+ ignored senders, which the original
    counted nowhere) -- computed from aggregates, no per-message join."""
    acc = F.lower(address_part("remetente")) == F.lit(address.lower())
    failed = F.col(parse_error).isNotNull() if parse_error else F.lit(False)
    none = F.lit(None).cast("long")
    counts = landed.agg(F.count(F.when(~failed, F.lit(1))).alias("_total"),
                        F.count(F.when(acc & ~failed, F.lit(1))).alias("_acc"),
                        F.count(F.when(failed, F.lit(1))).alias("_failed"), none.alias("_saved"))
    saved = new_keys(landed.where(~failed), existing, address).agg(
        none.alias("_total"), none.alias("_acc"), none.alias("_failed"), F.count(F.lit(1)).alias("_saved"))
    # Two one-row aggregates folded into one row (no join needed).
    out = counts.unionByName(saved).agg(*[F.max(c).alias(c) for c in ("_total", "_acc", "_failed", "_saved")])
    return out.select(F.col("_saved").alias("salvos"),
                      (F.col("_acc") - F.col("_saved")).alias("duplicados"),
                      F.col("_failed").alias("falhas"),
                      (F.col("_total") - F.col("_acc")).alias("ignorados"))


def progress(outcome_rows: DataFrame) -> DataFrame:
    """``total``, ``atual`` (zero-based index of the last handled message),
    ``finalizado`` and ``percentual`` from per-message outcomes."""
    agg = outcome_rows.agg(F.count(F.lit(1)).alias("total"),
                           F.count("resultado").alias("_done"))
    atual = F.greatest(F.col("_done") - 1, F.lit(0))
    return agg.select("total", atual.cast("long").alias("atual"),
                      (F.col("_done") == F.col("total")).alias("finalizado"),
                      F.round(F.try_divide(atual * 100, F.col("total")), 2).alias("percentual"))


def outcome_log(outcome_rows: DataFrame, at: Column) -> DataFrame:
    """One log record per message outcome (tipo, mensagem, timestamp)."""
    tipo = F.when(F.col("resultado") == OUTCOME_FAILED, F.lit("ERROR")) \
            .when(F.col("resultado") == OUTCOME_DUPLICATE, F.lit("INFO")) \
            .otherwise(F.lit("INFO"))
    msg = F.format_string("E-mail #%d: %s", F.col("seq"), F.col("resultado"))
    return outcome_rows.select(tipo.alias("tipo"), msg.alias("mensagem"),
                               F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
