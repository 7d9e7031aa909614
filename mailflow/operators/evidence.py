"""F20 with text: do the extracted identifiers occur in the attachments?

The mail's own subject and body, where the identifiers came from, prove
nothing; they are looked for in the attachments' names and, where it is given,
in their text. Both sides are normalised (upper case, letters and digits only),
so hyphens, dots and blanks do not matter, and matched as whole tokens by a
join of exploded tokens: a mail with very many attachments is reduced to its
distinct tokens map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("processo", "opaj", "identificador")
# A lettered identifier with its separators, or digits with the separators of a case number.
TOKEN = r"(?i)(?:FNDA|DILA)[-–:/\s]{0,3}\d{6,}|\d(?:[.\-/\s]?\d)*"
EXTENSION = ("dilação de prazo", "dilacao de prazo", "prorrogação de prazo", "prorrogacao de prazo")


def normalised(c) -> Column:
    """Upper case, letters and digits only; NULL if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.lit(""))


def tokens_of(df: DataFrame, text: str) -> DataFrame:
    """``id_email, token``: the identifier-like tokens of a text column, and the digits of those with letters around."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), normalised)
    parts = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\d+"), F.lit(0)), normalised)
    return df.select("id_email", F.explode(F.array_distinct(F.concat(found, parts))).alias("token")).where("token is not null")


def identifier_evidence(mails: DataFrame, anexos: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``mails`` with ``{kind}_ok`` (NULL without such an identifier) and ``ids_ok`` (none is missing).

    ``mails`` has ``id_email`` and the extracted identifiers, ``anexos`` the
    names, ``texts`` (``id_email, texto``) the text of attachments.
    """
    tokens = tokens_of(anexos.select("id_email", "nome_arquivo"), "nome_arquivo")
    if texts is not None:
        tokens = tokens.unionByName(tokens_of(texts.select("id_email", "texto"), "texto"))
    wanted = mails.select("id_email", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), normalised(F.col(k)).alias("token")) for k in KINDS])).alias("w"))
    wanted = wanted.select("id_email", "w.kind", "w.token").where("token is not null").distinct()
    hits = (wanted.join(tokens.distinct(), ["id_email", "token"], "left_semi")
            .groupBy("id_email").agg(F.collect_set("kind").alias("_found")))  # at most one of each kind
    out = mails.join(hits, "id_email", "left")
    for k in KINDS:
        out = out.withColumn(f"{k}_ok", F.when(normalised(F.col(k)).isNotNull(), F.coalesce(
            F.array_contains("_found", k), F.lit(False))))
    ok = F.lit(True)
    for k in KINDS:
        ok = ok & F.coalesce(F.col(f"{k}_ok"), F.lit(True))
    return out.withColumn("ids_ok", ok).drop("_found")


def extension_asked(mails: DataFrame, texts: DataFrame, status: str = "status_final") -> DataFrame:
    """Adds ``pedido_ok``: a mail about an extension has an attachment whose text asks for one (else NULL)."""
    asks = F.lit(False)
    for phrase in EXTENSION:
        asks = asks | F.lower("texto").contains(phrase)
    with_request = texts.where(asks).select("id_email").distinct().withColumn("_pede", F.lit(True))
    out = mails.join(with_request, "id_email", "left")
    about = F.upper(F.coalesce(status, F.lit(""))).contains("DILA")
    return out.withColumn("pedido_ok", F.when(about, F.coalesce("_pede", F.lit(False)))).drop("_pede")
