"""Registered queries of the capture job over raw mail, and of the tables it and the validation keep current.

Each reads the given tables through the stored fixtures. Queries that look at
different tables of one run share it: it is made once per session and folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import extract as X
from ..functions import verdict as V
from ..operators import boards as B
from ..operators import capture as K
from ..operators import evidence as EV
from ..operators import upsert as U
from ..operators import validation as VA
from ..operators.upsert import conform_to
from ..session import scratch_path
from ..sinks.partitioned import range_width, read_ranges, upsert_ranges, write_ranges
from ..sinks.tables import export_report, write_outcome_log
from ..sources.fixtures import stored_fixtures
from ..sources.mailparse import as_bundle, render_raw_mail
from ..streaming import caselog as CL
from ..streaming import mailbox as MB
from .queries import REPORT_FROM, REPORT_TO, SENDER, _as_of

WAVES, COURT = 3, "8.26"
BUNDLE = 10_000  # messages of a landed file: a task holds a whole one
_runs: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _runs:
        _runs[key] = make()
    return _runs[key]


# -- capture of raw mail ------------------------------------------------------------
def landed_mail(t, part: Column) -> DataFrame:
    """The landed messages of ``part`` as raw mail; some have no id, some a charset nobody knows."""
    seq = F.col("seq")
    odd = (t.captura.where(part).withColumn("message_id", F.when(seq % 17 != 3, F.col("message_id")))
           .withColumn("charset", F.when(seq % 23 == 5, F.lit("x-desconhecida")).otherwise(F.lit("utf-8"))))
    return render_raw_mail(odd, t.captura_anexos.where(part)).withColumn(
        "seq", F.regexp_extract("path", r"(\d+)\.eml$", 1).cast("long"))


def land(spark: SparkSession, t, folder: str, wave: int) -> None:
    """Lands a third of the messages, in mailbox order, as bundles."""
    last = t.captura.agg(F.max("seq")).first()[0]
    start, end = (-(-w * ((-1 if last is None else last) + 1) // WAVES) for w in (wave, wave + 1))
    raw = landed_mail(t, (F.col("seq") >= start) & (F.col("seq") < end))
    as_bundle(raw.repartitionByRange("seq").sortWithinPartitions("seq")).write.mode("append") \
        .option("maxRecordsPerFile", BUNDLE).text(folder)


def _captured(spark: SparkSession, sf_dir: str) -> str:
    """Lands the mail in waves and captures each; gives the folder of the captured tables."""
    def run() -> str:
        t = stored_fixtures(spark, sf_dir)
        base = scratch_path(spark, f"captura-{uuid.uuid4().hex}")
        for wave in range(WAVES):
            land(spark, t, f"{base}/caixa", wave)
            MB.run_capture(spark, f"{base}/caixa", f"{base}/tabelas", SENDER, _as_of(), existing=t.emails)
        return f"{base}/tabelas"
    return _once(spark, sf_dir, "captura", run)


def raw_capture_emails(spark, sf_dir):
    return MB.read_captured(spark, _captured(spark, sf_dir), "emails")


def raw_capture_attachments(spark, sf_dir):
    a = MB.read_captured(spark, _captured(spark, sf_dir), "anexos")
    return a.withColumn("conteudo", F.md5("conteudo"))


def raw_capture_quality(spark, sf_dir):
    q = MB.read_captured(spark, _captured(spark, sf_dir), "falhas_qualidade")
    return q.withColumn("erros", F.array_join("erros", ","))


def raw_capture_outcomes(spark, sf_dir):
    r = MB.read_captured(spark, _captured(spark, sf_dir), "resultados")
    return r.groupBy("lote", "resultado", "message_id").agg(F.count(F.lit(1)).alias("n"),
                                                            F.count("erro_parse").alias("n_erros"))


def raw_capture_progress(spark, sf_dir):
    """A row per micro-batch, with the totals of its outcomes."""
    p = MB.progress_table(spark, _captured(spark, sf_dir))
    return p.select("lote", (F.col("n_arquivos") > 0).alias("com_arquivos"), "total", "salvos", "duplicados", "falhas",
                    "ignorados", "atual")


# -- upserts of touched ranges ---------------------------------------------------------
RANGE_KEYS = 5000  # keys of a range at least
BACKLOG_DAY = "1995-07-21"


def reply_upsert_ranges(spark, sf_dir):
    """W4 into a table kept in key ranges; only those of the new replies are rewritten."""
    t = stored_fixtures(spark, sf_dir)
    stored = conform_to(t.respostas, schemas.RESPOSTAS)
    width = range_width(stored, "id_email", RANGE_KEYS)
    path = write_ranges(stored, scratch_path(spark, f"respostas-{uuid.uuid4().hex}"), "id_email", width)
    requests = VA.backlog_requests(t.emails, t.protocolos, t.anexos_email)
    rows = VA.reply_rows(VA.verdicts_from_text(requests, t.ia_respostas), _as_of())
    upsert_ranges(spark, path, rows, "id_email", VA.REPLY_UPDATE_COLS, width,
                  new_key=F.lit(2000000) + F.col("id_email"), key_col="id_resposta")
    return read_ranges(spark, path).drop("faixa").withColumn("erros", F.array_join("erros", ",")) \
        .withColumn("nomes_anexos", F.array_join("nomes_anexos", ","))


def filing_update_ranges(spark, sf_dir):
    """W7 (update only) into a table kept in key ranges."""
    t = stored_fixtures(spark, sf_dir)
    width = range_width(t.protocolos, "id_protocolo", RANGE_KEYS)
    path = write_ranges(t.protocolos, scratch_path(spark, f"protocolos-{uuid.uuid4().hex}"), "id_protocolo", width)
    last = U.last_per_key(t.filing_requests, "id_protocolo", [F.col("solicitado_em"), F.col("seq")])
    rows = last.select("id_protocolo", F.lit("protocolado").alias("acao_usuario"), F.col("usuario").alias("usuario_protocolo"),
                       F.col("solicitado_em").alias("protocolado_em"), F.col("nome_recibo").alias("recibo_protocolo"), "observacao")
    upsert_ranges(spark, path, rows, "id_protocolo", [c for c in rows.columns if c != "id_protocolo"], width, insert=False)
    return read_ranges(spark, path).drop("faixa")


# -- scorer ------------------------------------------------------------------------------
def rule_scorer(rows):
    """A deterministic scorer that answers by the key and fails on some rows (and so on any batch with one)."""
    import pandas as pd
    if (rows["id_email"] % 11 == 4).any():
        raise TimeoutError("tempo esgotado")
    answered = rows[rows["id_email"] % 13 != 6]
    texts = {0: '{"valido": true, "campos_faltantes": [], "coerencia": true, "motivo": "ok", "acao_sugerida": "protocolar"}',
             1: '```json\n{"valido": false, "campos_faltantes": ["minuta"], "motivo": "sem minuta", "acao_sugerida": "rejeitar"}\n```',
             2: "Desculpe, nao posso."}
    return pd.DataFrame({"id_email": answered["id_email"], "conteudo": (answered["id_email"] % 3).map(texts)})


def scored_verdicts(spark, sf_dir):
    """2.11 and F18: the backlog's requests scored by a function; failing rows get the call-failure verdict."""
    t = stored_fixtures(spark, sf_dir)
    requests = VA.backlog_requests(t.emails, t.protocolos, t.anexos_email)
    v = V.parse_scored(V.score_with(requests, rule_scorer))
    return v.select("id_email", "valido", "coerencia", "motivo", "acao_sugerida", "erro_ia", "erro_chamada",
                    F.array_join("campos_faltantes", ",").alias("faltantes"))


# -- case detail, backlog page, report and log files -------------------------------------
def case_detail_rows(spark, sf_dir):
    t = stored_fixtures(spark, sf_dir)
    return B.case_detail_rows(t.emails, t.respostas, t.anexos_email, t.protocolos)


def validation_backlog_page(spark, sf_dir):
    """T5: the first 25 mails of the backlog."""
    t = stored_fixtures(spark, sf_dir)
    return B.validation_backlog(t.emails, t.protocolos, limite=25)


def validation_backlog_day(spark, sf_dir):
    """The whole backlog of one day."""
    t = stored_fixtures(spark, sf_dir)
    return B.validation_backlog(t.emails, t.protocolos, data=BACKLOG_DAY, limite=0)


def report_export(spark, sf_dir):
    """The report written as CSV by month, and read back."""
    t = stored_fixtures(spark, sf_dir)
    path = scratch_path(spark, f"relatorio-{uuid.uuid4().hex}")
    rows = B.report_rows(t.emails, t.protocolos, t.respostas, REPORT_FROM, REPORT_TO, sort=False)
    cols = ["id_protocolo", "id_email", "status", "assunto", "remetente", "recebido_em", "processo", "opaj"]
    export_report(rows.select(*cols), path)
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in cols)
    return spark.read.option("header", True).schema(f"{schema}, mes string").csv(path)


def outcome_log(spark, sf_dir):
    """The capture's outcomes written as JSON lines, and read back."""
    t = stored_fixtures(spark, sf_dir)
    path = scratch_path(spark, f"registro-{uuid.uuid4().hex}")
    write_outcome_log(K.outcome_log(K.outcomes(t.captura, t.emails, SENDER), _as_of()), path)
    return spark.read.schema("tipo string, mensagem string, timestamp string").json(path)


def stream_validation_log(spark, sf_dir):
    """R2: validation as a stream whose new cases are deltas beside the base."""
    t = stored_fixtures(spark, sf_dir)
    stored = conform_to(t.protocolos, schemas.PROTOCOLOS)
    width = range_width(stored, "id_email", RANGE_KEYS)
    base = write_ranges(stored, scratch_path(spark, f"casos-{uuid.uuid4().hex}"), "id_email", width)
    log = f"{base}-deltas"
    CL.run_validation(spark, t.store("emails"), base, log, t.anexos_email, t.ia_respostas, _as_of(),
                      F.lit(1000000) + F.col("id_email"), width)
    new = CL.open_deltas(spark, log, "protocolos").drop("lote", "faixa")
    return new.select(*[f.name for f in schemas.PROTOCOLOS.fields])


def identifier_evidence(spark, sf_dir):
    """F20 with text: identifiers of the mails looked for in attachment names and contents."""
    t = stored_fixtures(spark, sf_dir)
    mails = X.extract_fields(t.emails).select("id_email", "processo", "opaj", "identificador")
    texts = (t.anexos_conteudo.join(t.anexos_email.select("id_anexo", "id_email"), "id_anexo")
             .select("id_email", F.col("conteudo").cast("string").alias("texto")))
    return EV.identifier_evidence(mails, t.anexos_email, texts)


def report_by_court(spark, sf_dir):
    """The report of one court."""
    t = stored_fixtures(spark, sf_dir)
    return B.report_rows(t.emails, t.protocolos, t.respostas, REPORT_FROM, REPORT_TO, tribunal=COURT)


def court_totals(spark, sf_dir):
    """Cases per court of the replies; the counts are combined before the shuffle."""
    r = stored_fixtures(spark, sf_dir).respostas.withColumn("tribunal", X.court("processo"))
    return r.groupBy("tribunal").agg(F.count(F.lit(1)).alias("n_respostas"), F.count_distinct("processo").alias("n_processos"))


def attachment_name_rows(spark, sf_dir):
    """J13 in long form: names with their positions, whatever the number in a mail."""
    return B.attachment_name_rows(stored_fixtures(spark, sf_dir).anexos_email)


def sender_forms(spark, sf_dir):
    """The accepted sender written bare, with a name, a comment or a quoted name that holds another address."""
    a, k = F.col("remetente"), F.col("seq") % 5
    header = (F.when(k == 0, a).when(k == 1, F.concat(F.lit("Setor <"), a, F.lit(">")))
              .when(k == 2, F.concat(a, F.lit(" (Setor (norte))")))
              .when(k == 3, F.concat(F.lit('"Vara <x@y.z>" <'), a, F.lit(">")))
              .otherwise(F.concat(F.lit("(cópia) "), a)))
    landed = stored_fixtures(spark, sf_dir).captura.select("seq", header.alias("remetente"))
    return K.sender_filter(landed, SENDER).select("seq", F.lower(K.address_part("remetente")).alias("endereco"))


def verdict_repeated_keys(spark, sf_dir):
    """texts whose JSON repeats a key; the last value counts."""
    ia = stored_fixtures(spark, sf_dir).ia_respostas
    twice = F.replace("conteudo", F.lit('"motivo": '), F.lit('"motivo": "antes", "motivo": '))
    p = V.parse_verdict(ia.withColumn("conteudo", twice), "conteudo")
    return p.select("id_email", "valido", "coerencia", "motivo", "acao_sugerida", "erro_ia")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [
        raw_capture_emails, raw_capture_attachments, raw_capture_quality, raw_capture_outcomes, raw_capture_progress,
        reply_upsert_ranges, filing_update_ranges, scored_verdicts, case_detail_rows, validation_backlog_page,
        validation_backlog_day, report_export, outcome_log, stream_validation_log,
        identifier_evidence, report_by_court, court_totals, attachment_name_rows, sender_forms, verdict_repeated_keys,
    ]
}
