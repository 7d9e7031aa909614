"""One capture pass over parsed messages (P7, J7, N1, W1-W3, F9, F13, F14, A4): mails, attachments, quality rows, outcomes.

Every message gets one outcome, by the rules of a pass that takes messages in
order: another sender is ignored; an id stored before, or saved earlier in the
pass, is a duplicate; a message that cannot be parsed is a failure (and does
not make later copies duplicates); all others are saved. Keys are made here,
once, from the message id: ``id_email`` of a mail, ``id_anexo`` of each of its
attachments, so later steps never hash bodies again.

Null sender, subject or body are values like others; a message without an id
gets one from its content; messages without any readable header are failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import mail_type
from ..functions.extract import received_time
from .capture import (BAD_BODY, BAD_BODY_MSG, MIN_BODY_CHARS, NO_ATTACHMENT, NO_ATTACHMENT_MSG, OUTCOME_DUPLICATE,
                      OUTCOME_FAILED, OUTCOME_IGNORED, OUTCOME_SAVED, identified, mail_key)

PLACE = ("path", "indice")
TABLES = ("emails", "anexos", "falhas_qualidade", "resultados")


def landed_messages(parsed: DataFrame, as_of: Column) -> DataFrame:
    """Parsed messages with received time and an id (made from content where there is none)."""
    return identified(parsed.withColumn("recebido_em", received_time("recebido_em_raw", as_of)))


def pass_outcomes(messages: DataFrame, known: DataFrame, address: str) -> DataFrame:
    """``path, indice, message_id, resultado, erro_parse`` of every message; bodies take no part in the joins."""
    m = messages.select(*PLACE, "message_id", "erro_parse",
                        F.coalesce(F.lower("remetente") == address.lower(), F.lit(False)).alias("_aceito"),
                        F.col("remetente").isNull().alias("_ilegivel"))
    first = (m.where(F.col("_aceito") & F.col("erro_parse").isNull())
             .groupBy("message_id").agg(F.min(F.struct(*PLACE)).alias("_primeiro")))
    stored = known.select("message_id").distinct().withColumn("_conhecido", F.lit(True))
    # A repeated id is one row on the joins' other side, so a hot id only repeats on the side that AQE splits.
    m = m.join(first, "message_id", "left").join(stored, "message_id", "left")
    result = (F.when(F.col("_ilegivel"), OUTCOME_FAILED)
              .when(~F.col("_aceito"), OUTCOME_IGNORED)
              .when(F.col("_conhecido") | (F.struct(*PLACE) > F.col("_primeiro")), OUTCOME_DUPLICATE)
              .when(F.col("erro_parse").isNotNull(), OUTCOME_FAILED)
              .otherwise(OUTCOME_SAVED))
    return m.select(*PLACE, "message_id", result.alias("resultado"), "erro_parse")


def stored_mails(saved: DataFrame) -> DataFrame:
    """The mail rows of saved messages."""
    return saved.select(mail_key().alias("id_email"), "message_id", "remetente", "assunto", "recebido_em", "corpo_email",
                        mail_type("assunto").alias("tipo_email"))


def stored_parts(saved: DataFrame) -> DataFrame:
    """One row per non-empty attachment, with its key, its size and its bytes."""
    parts = saved.select("message_id", F.posexplode("anexos").alias("_i", "_a"))
    size = F.length("_a.conteudo")
    return parts.where(size > 0).select(
        F.md5(F.concat_ws("#", "message_id", F.col("_i") + 1).cast("binary")).alias("id_anexo"), mail_key().alias("id_email"),
        (F.col("_i") + 1).alias("parte"), "_a.nome_arquivo", "_a.tipo_arquivo", size.alias("tamanho"), "_a.conteudo")


def failed_quality(saved: DataFrame) -> DataFrame:
    """A row for each saved message without attachments, or else with too short a body."""
    n = F.size(F.filter("anexos", lambda a: F.length(a["conteudo"]) > 0))
    body = F.coalesce(F.length("corpo_email"), F.lit(0)) < MIN_BODY_CHARS
    status = F.when(n == 0, NO_ATTACHMENT).when(body, BAD_BODY)
    text = F.when(status == NO_ATTACHMENT, NO_ATTACHMENT_MSG).otherwise(BAD_BODY_MSG)
    return saved.withColumn("status", status).where(F.col("status").isNotNull()).select(
        mail_key().alias("id_email"), "message_id", F.col("status").alias("tipo_resposta"), "status",
        F.lit("erro").alias("status_validacao"), F.lit(False).alias("validado"), F.array(text).alias("erros"),
        F.col("recebido_em").alias("data_chegada"))


def capture_pass(messages: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """The tables of a pass, by name, from its messages and their outcomes."""
    saved = messages.join(outcomes.where(F.col("resultado") == OUTCOME_SAVED).select(*PLACE), list(PLACE), "left_semi")
    return dict(zip(TABLES, (stored_mails(saved), stored_parts(saved), failed_quality(saved), outcomes)))


def pass_totals(outcomes: DataFrame) -> DataFrame:
    """A4: one row ``total, salvos, duplicados, falhas, ignorados``."""
    def of(name: str, outcome: str) -> Column:
        return F.count(F.when(F.col("resultado") == outcome, 1)).alias(name)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), of("salvos", OUTCOME_SAVED), of("duplicados", OUTCOME_DUPLICATE),
                        of("falhas", OUTCOME_FAILED), of("ignorados", OUTCOME_IGNORED))
