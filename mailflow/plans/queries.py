"""Registered queries: one per operator of the inventory, over whole tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame built from
the driver tables (through ``FixtureTables``). Parameters are the endpoint
defaults unless the query exists to exercise a parameter. Output column
names match ``plans.oracle`` exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import display as D
from ..functions import extract as X
from ..functions import verdict as V
from ..operators import boards as B
from ..operators import capture as K
from ..operators import ranking as R
from ..operators import upsert as U
from ..operators import validation as VA
from ..sources.fixtures import FixtureTables, stored_fixtures

# Fixed parameters of the registered queries.
AS_OF = "2026-01-01 00:00:00"
SENDER = "respostas@example.com"
BOARD_DAY = "1996-03-15"
REPORT_FROM, REPORT_TO = "1996-01-01", "1996-12-31"
DEFAULT_USER = "usuario"


def _t(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return stored_fixtures(spark, sf_dir)


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _board(t: FixtureTables, **kw) -> DataFrame:
    return B.case_board(t.emails, t.protocolos, t.respostas, **kw)


# -- queues and listings ------------------------------------------------------
def case_board_attachments(spark, sf_dir):
    t = _t(spark, sf_dir)
    page = _board(t)
    return B.attachments_of(page, t.anexos_email, B.BOARD_LIMIT)


def case_board(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.with_attachment_count(_board(t), t.anexos_email, B.BOARD_LIMIT)


def board_by_date(spark, sf_dir):
    return _board(_t(spark, sf_dir), data=BOARD_DAY)


def board_by_action(spark, sf_dir):
    return _board(_t(spark, sf_dir), acao_ia="revisar")


def board_by_status(spark, sf_dir):
    return _board(_t(spark, sf_dir), status="invalid")


def board_facets(spark, sf_dir):
    return B.board_facets(_board(_t(spark, sf_dir)))


def board_count(spark, sf_dir):
    return B.board_count(_board(_t(spark, sf_dir), limite=None))


def validation_backlog(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.validation_backlog(t.emails, t.protocolos)


def pending_count(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.pending_count(t.emails, t.protocolos)


def pending_count_by_status(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.pending_count(t.emails, t.protocolos, status="protocolado")


def protocol_listing(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.protocol_listing(t.emails, t.protocolos, t.respostas, t.anexos_email)


def optional_filters(spark, sf_dir):
    """Empty strings mean 'no filter' (all mail types, any status)."""
    t = _t(spark, sf_dir)
    return B.protocol_listing(t.emails, t.protocolos, t.respostas, t.anexos_email,
                              tipo_email="", status="", data="")


def communications(spark, sf_dir):
    return B.communications(_t(spark, sf_dir).emails)


def report_range(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.report_rows(t.emails, t.protocolos, t.respostas, REPORT_FROM, REPORT_TO)


def case_flat_detail(spark, sf_dir):
    t = _t(spark, sf_dir)
    ids = t.divergencias.select("id_protocolo")
    return B.case_flat_detail(ids, t.emails, t.protocolos, t.respostas, t.anexos_email)


def case_detail(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.case_detail(t.emails, t.respostas, t.anexos_email, t.protocolos)


def filed_cases(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.filed_cases(t.emails, t.protocolos, t.respostas, t.anexos_email)


def reported_cases(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.reported_cases(t.emails, t.protocolos, t.respostas, t.anexos_email, t.divergencias)


def attachment_names(spark, sf_dir):
    return B.attachment_names(_t(spark, sf_dir).anexos_email).drop("nomes_anexos")


def attachment_flags(spark, sf_dir):
    a = _t(spark, sf_dir).anexos_email
    return a.select("id_anexo", "id_email", "nome_arquivo",
                    C.has_suffix("nome_arquivo", ".zip").alias("tem_zip"),
                    C.has_suffix("nome_arquivo", ".pdf").alias("tem_pdf"))


def attachment_lookup(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.attachment_lookup(t.download_requests, t.anexos_email, t.anexos_conteudo)


def reply_by_attachment(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.reply_by_attachment(t.download_requests, t.respostas)


def fileable_cases(spark, sf_dir):
    p = _t(spark, sf_dir).protocolos
    return p.select("id_protocolo", "status", C.fileable("status").alias("pode_protocolar"))


def status_labels(spark, sf_dir):
    p = _t(spark, sf_dir).protocolos
    return p.select("id_protocolo", "status", C.status_label("status").alias("rotulo"))


def active_users(spark, sf_dir):
    return B.active_users(_t(spark, sf_dir).usuarios)


def known_user_filings(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.known_user_filings(t.protocolos, t.usuarios)


def pending_panel(spark, sf_dir):
    """F22-F25 over the unbounded queue of open cases (J5 + P5)."""
    t = _t(spark, sf_dir)
    e = t.emails.filter(F.col("tipo_email") == "protocolo").select("id_email", "assunto")
    p = t.protocolos.filter(~F.col("status").isin(*B.CLOSED)).select(
        "id_email", "id_protocolo", "id_resposta", "status", "criado_em")
    r = t.respostas.select(F.col("id_resposta").alias("_rk"), "data_chegada", "status_validacao")
    rows = e.join(p, "id_email", "inner")
    rows = rows.join(r, rows["id_resposta"] == r["_rk"], "left").drop("_rk")
    when = D.display_time()
    return rows.select("id_email", "id_protocolo",
                       D.display_id().alias("id_exibicao"),
                       D.subject_cut().alias("assunto_curto"),
                       D.format_timestamp(when).alias("chegada"),
                       D.display_status().alias("status_exibicao"))


# -- extraction and classification -----------------------------------------------
def extract_fields(spark, sf_dir):
    e = _t(spark, sf_dir).emails
    return X.extract_fields(e.select("id_email", "assunto", "corpo_email")) \
        .select("id_email", "processo", "opaj", "identificador")


def extract_documents(spark, sf_dir):
    """F1-F3 and F8 over whole documents (long real text)."""
    d = _t(spark, sf_dir).driver("documents").select("doc_id", "text")
    t = F.col("text")
    return d.select("doc_id", X.case_number(t).alias("processo"),
                    X.order_number(t).alias("opaj"), X.identifier(t).alias("identificador"),
                    X.content_hash(t).alias("hash_documento"))


def content_hash_groups(spark, sf_dir):
    d = _t(spark, sf_dir).driver("documents").select("doc_id", "text")
    h = d.select("doc_id", X.content_hash("text").alias("hash_documento"))
    g = h.groupBy("hash_documento").agg(F.count(F.lit(1)).alias("n_documentos"),
                                        F.min("doc_id").alias("primeiro_doc"))
    return g.filter(F.col("n_documentos") > 1)


def extract_subject_refs(spark, sf_dir):
    e = _t(spark, sf_dir).emails.select("id_email", "assunto")
    return X.subject_refs(e).drop("assunto")


def extract_strict(spark, sf_dir):
    e = _t(spark, sf_dir).emails
    text = X.mail_text()
    return e.select("id_email", X.strict_case_number(text).alias("processo_estrito"),
                    X.strict_order_number(text).alias("opaj_estrito"))


def classify_mail(spark, sf_dir):
    o = _t(spark, sf_dir).emails
    return o.select("id_email", "assunto", C.mail_type("assunto").alias("tipo_classificado"))


def attachment_completeness(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = t.emails.select("id_email", "assunto", "corpo_email")
    out = C.attachment_completeness(m, t.anexos_email)
    return out.select("id_email", F.array_join("faltantes", ",").alias("faltantes"),
                      "status_contexto")


def received_time(spark, sf_dir):
    """parse date headers written from capture times (some malformed)."""
    c = _t(spark, sf_dir).captura
    header = (F.when(F.col("seq") % 9 == 0, F.lit("data invalida"))
              .when(F.col("seq") % 9 == 1,
                    F.date_format("recebido_em", "dd MMM yyyy HH:mm:ss '+0000'"))
              .otherwise(F.date_format("recebido_em", "EEE, dd MMM yyyy HH:mm:ss '-0300'")))
    c = c.select("seq", header.alias("cabecalho_data"))
    return c.select("seq", "cabecalho_data",
                    X.received_time("cabecalho_data", _as_of()).alias("recebido_em"))


# -- verdicts ----------------------------------------------------------------------
def _requests(t: FixtureTables) -> DataFrame:
    return VA.backlog_requests(t.emails, t.protocolos, t.anexos_email)


def verdict_prompt(spark, sf_dir):
    req = _requests(_t(spark, sf_dir))
    return req.select("id_email", F.substring(F.coalesce("corpo_email", F.lit("")), 1,
                                              V.BODY_PROMPT_CHARS).alias("corpo_prompt"),
                      F.coalesce("nomes_texto", F.lit("")).alias("nomes_texto"),
                      "campos_json", "prompt")


def verdict_parse(spark, sf_dir):
    ia = _t(spark, sf_dir).ia_respostas
    p = V.parse_verdict(ia, "conteudo")
    return p.select("id_email", "valido", "coerencia", "motivo", "acao_sugerida", "erro_ia",
                    F.array_join("campos_faltantes", ",").alias("faltantes"),
                    F.size("campos_faltantes").alias("n_faltantes"))


def verdict_routing(spark, sf_dir):
    t = _t(spark, sf_dir)
    v = VA.verdicts_from_text(_requests(t), t.ia_respostas)
    r = V.route_verdict(v)
    return r.select("id_email", "status", "motivo_invalido", "observacao", "tipo_resposta",
                    "status_validacao", "validado", "processo", "opaj", "identificador")


def formal_rules(spark, sf_dir):
    t = _t(spark, sf_dir)
    v = VA.verdicts_from_rules(_requests(t), t.anexos_email)
    return v.select("id_email", "acao_sugerida", "valido", "coerencia", "motivo",
                    F.array_join("campos_faltantes", ",").alias("faltantes"))


# -- mutations ---------------------------------------------------------------------
def reply_upsert(spark, sf_dir):
    t = _t(spark, sf_dir)
    v = VA.verdicts_from_text(_requests(t), t.ia_respostas)
    rows = VA.reply_rows(v, _as_of())
    out = VA.apply_replies(t.respostas, rows, F.lit(2000000) + F.col("id_email"))
    return out.withColumn("erros", F.array_join("erros", ",")) \
              .withColumn("nomes_anexos", F.array_join("nomes_anexos", ","))


def protocol_append(spark, sf_dir):
    t = _t(spark, sf_dir)
    v = VA.verdicts_from_text(_requests(t), t.ia_respostas)
    return VA.protocol_rows(v, t.protocolos, _as_of(), F.lit(1000000) + F.col("id_email"))


def control_flag_upsert(spark, sf_dir):
    """Pause commands upsert their flag; resume commands only update."""
    t = _t(spark, sf_dir)
    last = U.last_per_key(t.flag_commands, "chave", [F.col("emitido_em"), F.col("seq")])
    return U.upsert(t.controle_pipeline, last.select("chave", "valor"), "chave", ["valor"],
                    insert_only_when=F.col("valor") == "true")


def filing_update(spark, sf_dir):
    """Mark cases as filed from the latest request per case (update only)."""
    t = _t(spark, sf_dir)
    req = U.last_per_key(t.filing_requests, "id_protocolo",
                         [F.col("solicitado_em"), F.col("seq")])
    upd = req.select("id_protocolo", F.lit("protocolado").alias("acao_usuario"),
                     F.col("usuario").alias("usuario_protocolo"),
                     F.col("solicitado_em").alias("protocolado_em"),
                     F.col("nome_recibo").alias("recibo_protocolo"), "observacao")
    cols = ["acao_usuario", "usuario_protocolo", "protocolado_em", "recibo_protocolo",
            "observacao"]
    return U.upsert(t.protocolos, upd, "id_protocolo", cols, insert=False)


def divergence_append(spark, sf_dir):
    """Accepted problem reports (reason required, empty user -> 'usuario')."""
    rep = _t(spark, sf_dir).divergence_reports
    ok = rep.filter(F.length(F.trim(F.coalesce("motivo_manual", F.lit("")))) > 0)
    return ok.select("id_divergencia", "id_protocolo",
                     F.coalesce(F.nullif("usuario", F.lit("")), F.lit(DEFAULT_USER)).alias("usuario"),
                     "motivo_manual", "observacao", "data_registro")


def validation_history(spark, sf_dir):
    v = _t(spark, sf_dir).validacoes
    return R.rank_within(v, "id_resposta", [F.col("data_validacao").desc(),
                                            F.col("id_validacao").desc()], "posicao")


def validation_latest(spark, sf_dir):
    v = _t(spark, sf_dir).validacoes
    return U.last_per_key(v, "id_resposta", [F.col("data_validacao"), F.col("id_validacao")])


# -- capture -----------------------------------------------------------------------
def sender_filter(spark, sf_dir):
    c = _t(spark, sf_dir).captura
    return K.sender_filter(c, SENDER).select("seq", "message_id", "remetente")


def capture_new_messages(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.new_messages(t.captura, t.emails, SENDER)


def capture_emails(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.keyed_emails(K.new_messages(t.captura, t.emails, SENDER))


def capture_attachments(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.stored_attachments(K.new_keys(t.captura, t.emails, SENDER), t.captura_anexos)


def capture_quality_failures(spark, sf_dir):
    t = _t(spark, sf_dir)
    q = K.quality_failures(K.new_messages(t.captura, t.emails, SENDER), t.captura_anexos)
    return q.withColumn("erros", F.array_join("erros", ","))


def capture_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.summary(t.captura, t.emails, SENDER)


def capture_outcomes(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.outcomes(t.captura, t.emails, SENDER)


def capture_progress(spark, sf_dir):
    t = _t(spark, sf_dir)
    return K.progress(K.outcomes(t.captura, t.emails, SENDER)).drop("percentual")


def mail_parse(spark, sf_dir):
    from ..sources.mailparse import parse_raw_mail, render_raw_mail
    t = _t(spark, sf_dir)
    raw = render_raw_mail(t.captura, t.captura_anexos)
    # Parsing is Python CPU work: spread it over every core instead of the
    # few byte-sized partitions AQE would coalesce the small input into.
    raw = raw.repartition(spark.sparkContext.defaultParallelism)
    parsed = parse_raw_mail(raw)
    return parsed.select("path", "message_id", "remetente", "assunto", "corpo_email",
                         F.size("anexos").alias("n_partes"),
                         F.size(F.filter("anexos", lambda a: F.length(a["conteudo"]) > 0))
                         .alias("n_anexos_salvos"))


def stream_capture(spark, sf_dir):
    from ..streaming.capture import run_capture_stream
    return run_capture_stream(spark, sf_dir, SENDER)


def stream_validation(spark, sf_dir):
    """R2: validation as a stream over the stored mails; returns the new cases."""
    from ..streaming.validation import run_validation_stream
    t = _t(spark, sf_dir)
    cases_path, _ = run_validation_stream(spark, t, _as_of(), F.lit(1000000) + F.col("id_email"))
    cases = spark.read.parquet(cases_path)
    return cases.join(t.protocolos.select("id_protocolo"), "id_protocolo", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [
        case_board_attachments, case_board, board_by_date, board_by_action, board_by_status,
        board_facets, board_count, validation_backlog, pending_count, pending_count_by_status,
        protocol_listing, optional_filters, communications, report_range, case_flat_detail,
        case_detail, filed_cases, reported_cases, attachment_names, attachment_flags,
        attachment_lookup, reply_by_attachment, fileable_cases, status_labels, active_users,
        known_user_filings, pending_panel, extract_fields, extract_documents,
        content_hash_groups, extract_subject_refs, extract_strict, classify_mail,
        attachment_completeness, received_time, verdict_prompt, verdict_parse,
        verdict_routing, formal_rules, reply_upsert, protocol_append, control_flag_upsert,
        filing_update, divergence_append, validation_history, validation_latest,
        sender_filter, capture_new_messages, capture_emails, capture_attachments,
        capture_quality_failures, capture_summary, capture_outcomes, capture_progress,
        mail_parse, stream_capture, stream_validation,
    ]
}
