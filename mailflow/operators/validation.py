"""The validation step as one Spark job (J1 -> J13 -> F1-F3 -> verdict -> F19
-> W4/W5), replacing a per-mail loop with one query per mail.

The verdict comes either from raw scorer text (``verdicts_from_text``, e.g.
the output of ``functions.verdict.score_with``) or from the deterministic
formal rules (``verdicts_from_rules``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.classify import formal_rules
from ..functions.extract import extract_fields
from ..functions.verdict import fields_json, parse_verdict, route_verdict, verdict_prompt
from .boards import attachment_names, validation_backlog
from .common import spread, spread_count
from .upsert import append_new, conform_to, last_per_key, upsert

REPLY_UPDATE_COLS = ["tipo_resposta", "processo", "opaj", "coerente", "erros", "identificador",
                     "status", "status_validacao", "validado", "nomes_anexos", "resumo_ia",
                     "observacao", "data_chegada"]


def backlog_requests(emails: DataFrame, protocolos: DataFrame, anexos: DataFrame,
                     data=None, limite: int | None = None) -> DataFrame:
    """Backlog mails with attachment names, extracted fields and the request text."""
    n = spread_count(anexos)
    emails, anexos = spread(emails, "id_email", n), spread(anexos, "id_email", n)
    backlog = validation_backlog(emails, protocolos, data, limite)
    names = attachment_names(anexos.join(backlog.select("id_email"), "id_email", "left_semi"))
    req = backlog.join(names, "id_email", "left")
    req = req.withColumn("nomes_anexos", F.coalesce(F.col("nomes_anexos"),
                                                    F.array().cast("array<string>")))
    req = extract_fields(req)
    return req.withColumn("campos_json", fields_json()) \
              .withColumn("prompt", verdict_prompt())


def verdicts_from_text(requests: DataFrame, texts: DataFrame, order: str | None = None) -> DataFrame:
    """Parse scorer output ``(id_email, conteudo)`` for each request.

    Of several texts for one mail the last by ``order`` (a time or sequence)
    counts; without one, by ``recebido_em`` or ``seq`` where the texts carry
    it. Texts that agree in it, or carry neither, are told apart by content.
    """
    order = order or next((c for c in ("recebido_em", "seq") if c in texts.columns), "conteudo")
    last = last_per_key(texts.select("id_email", "conteudo", F.col(order).alias("_at")), "id_email", ["_at"])
    return parse_verdict(requests.join(last.select("id_email", "conteudo"), "id_email", "inner"),
                         "conteudo").drop("conteudo")


def verdicts_from_rules(requests: DataFrame, anexos: DataFrame) -> DataFrame:
    """Deterministic verdicts (F20) for each request."""
    return formal_rules(requests, spread(anexos, "id_email", spread_count(anexos)))


def reply_rows(verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Reply rows (W4 source) from verdicts; ``as_of`` is the arrival time."""
    routed = route_verdict(verdicts).withColumn("data_chegada", as_of)
    return routed.select("id_email", *REPLY_UPDATE_COLS)


def apply_replies(respostas: DataFrame, replies: DataFrame, new_key: Column) -> DataFrame:
    """Upsert reply rows on ``id_email``; ``new_key`` numbers inserted rows."""
    target = conform_to(respostas, schemas.RESPOSTAS)
    return upsert(target, replies, "id_email", REPLY_UPDATE_COLS, new_key=new_key,
                  key_col="id_resposta")


def protocol_rows(verdicts: DataFrame, protocolos: DataFrame, as_of: Column,
                  new_key: Column) -> DataFrame:
    """One new case row per validated mail not yet holding a case.

    ``hash_documento`` carries the extracted identifier (as the workflow
    always stored it). The anti join on ``id_email`` makes a retried run
    append nothing twice.
    """
    routed = route_verdict(verdicts)
    rows = routed.select(
        "id_email", "status", "motivo_invalido",
        as_of.alias("criado_em"), as_of.alias("ultima_atualizacao"),
        F.col("motivo").alias("observacao"), F.col("acao_sugerida").alias("acao_usuario"),
        F.col("identificador").alias("hash_documento"))
    rows = append_new(protocolos, rows, "id_email").withColumn("id_protocolo", new_key)
    return conform_to(rows, schemas.PROTOCOLOS)
