"""Work queues, listings, counts and reports.

Every function takes the data-model DataFrames and returns a DataFrame; no
function collects. Top-k pages are cut *before* the fan-out joins wherever the
semantics allow it, and the page (bounded by its limit) is the only side that
is ever broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import has_suffix
from ..functions.display import capitalize_first
from ..functions.extract import court
from .common import (asc_nf, bounded, desc_nf, given, in_date_range, left_join_bounded,
                     materialize_page, on_date, optional_filters, restrict_to, top_k)
from .ranking import rank_within

DEFAULT_TYPE = "protocolo"
LISTING_LIMIT = 200
BOARD_LIMIT = 100
COMMUNICATIONS_LIMIT = 200
CLOSED = ("protocolado", "cancelado")

REPLY_COLS = ("tipo_resposta", "processo", "opaj", "status_final", "acao_sugerida",
              "status_validacao", "motivo_invalido")


def _replies(respostas: DataFrame, cols, key: str = "id_resposta") -> DataFrame:
    return respostas.select(F.col(key).alias("_rkey"), *cols)


# -- J1 / T5 -----------------------------------------------------------------
def validation_backlog(emails: DataFrame, protocolos: DataFrame, data=None,
                       limite: int | None = None) -> DataFrame:
    """Mails of type 'protocolo' without any case row.

    Written as a LeftAnti join (not left join + IS NULL) so it plans as one.
    ``limite`` 0/None means all rows; otherwise the lowest ids first, so the
    page is deterministic.
    """
    e = on_date(emails.filter(F.col("tipo_email") == DEFAULT_TYPE), "recebido_em", data)
    # Distinct keys first (combined map-side): a mail with a huge number of
    # case rows becomes one row per task before the join's shuffle.
    out = e.join(protocolos.select("id_email").distinct(), "id_email", "left_anti")
    if limite:
        out = top_k(out, [F.col("id_email")], limite)
    return out


# -- A1 ----------------------------------------------------------------------
def pending_count(emails: DataFrame, protocolos: DataFrame, tipo_email=DEFAULT_TYPE,
                  status=None) -> DataFrame:
    """A1: distinct cases (joined to their mail) still being processed.

    Without a status the closed statuses are excluded; a NULL status is
    excluded too (three-valued NOT IN).
    """
    p = protocolos.select("id_protocolo", "id_email", "status")
    if given(status):
        p = p.filter(F.col("status") == F.lit(status))
    else:
        p = p.filter(~F.col("status").isin(*CLOSED))
    e = optional_filters(emails.select("id_email", "tipo_email"), tipo_email=tipo_email)
    joined = p.join(e.select("id_email"), "id_email", "left_semi")
    return joined.agg(F.countDistinct("id_protocolo").alias("total"))


# -- J2 J3 J4 P10 T1 ---------------------------------------------------------
def protocol_listing(emails: DataFrame, protocolos: DataFrame, respostas: DataFrame,
                     anexos: DataFrame, data=None, status=None, tipo_email=DEFAULT_TYPE,
                     limite: int = LISTING_LIMIT, reply_key: str = "id_resposta") -> DataFrame:
    """Case listing, one row per case x attachment, newest case first.

    The limit counts fan-out rows. Every case yields at least one row, so the
    first ``limite`` rows come from the first ``limite`` cases: the cases are
    cut to a page first and only that page meets replies and attachments.
    ``motivo_invalido`` is the reply's (the later duplicate name wins in the
    source listing); the case's own reason is ``motivo_invalido_protocolo``.
    """
    p = protocolos.select("id_protocolo", "id_email", "id_resposta", "status", "acao_usuario",
                          "hash_documento", "hash_email", "observacao",
                          F.col("motivo_invalido").alias("motivo_invalido_protocolo"),
                          "criado_em", "ultima_atualizacao")
    e = emails.select("id_email", "assunto", "remetente", "recebido_em", "corpo_email",
                      "tipo_email")
    e = on_date(optional_filters(e, tipo_email=tipo_email), "recebido_em", data)
    p = optional_filters(p, status=status)
    cases = p.join(e, "id_email", "inner")
    page = top_k(cases, [desc_nf("criado_em"), asc_nf("id_protocolo")], limite)
    page = materialize_page(page, limite)

    r = _replies(respostas, REPLY_COLS, reply_key)
    page = page.withColumn("_lkey", F.col(reply_key))
    rows = left_join_bounded(page, r, "_lkey", "_rkey", limite).drop("_lkey")
    rows = materialize_page(rows, limite)  # at most one reply a case
    a = anexos.select(F.col("id_email").alias("_aid"), "id_anexo", "nome_arquivo",
                      "tipo_arquivo")
    rows = left_join_bounded(rows, a, "id_email", "_aid", limite)
    rows = rows.withColumn("tem_zip", has_suffix("nome_arquivo", ".zip")) \
               .withColumn("tem_pdf", has_suffix("nome_arquivo", ".pdf"))
    return top_k(rows, [desc_nf("criado_em"), asc_nf("id_protocolo"), asc_nf("id_anexo")], limite)


# -- P6 T3 -------------------------------------------------------------------
def communications(emails: DataFrame, data=None, tipo=None,
                   limite: int = COMMUNICATIONS_LIMIT) -> DataFrame:
    """Mails that are not replies (NULL type excluded), newest first, 200."""
    e = emails.select("id_email", "assunto", "remetente", "recebido_em", "tipo_email",
                      "corpo_email").filter(F.col("tipo_email") != DEFAULT_TYPE)
    e = on_date(optional_filters(e, tipo_email=tipo), "recebido_em", data)
    return top_k(e, [desc_nf("recebido_em"), asc_nf("id_email")], limite)


# -- J5 J6 T2 P13 ------------------------------------------------------------
BOARD_REPLY_COLS = ("tipo_resposta", "processo", "opaj", "status_final", "acao_sugerida")


def case_board(emails: DataFrame, protocolos: DataFrame, respostas: DataFrame, data=None,
               status=None, tipo_email=DEFAULT_TYPE, limite: int | None = BOARD_LIMIT,
               acao_ia=None, reply_key: str = "id_resposta") -> DataFrame:
    """The work queue -- mails left-joined to cases and replies.

    Mails without a case stay (unless a status is asked for: the status
    predicate drops rows without a case). Ordered by case creation, else mail
    arrival, newest first; ``limite`` rows. ``acao_ia`` (P13) filters on the
    reply's suggested action; it needs the reply join before the cut.
    """
    e = emails.select("id_email", "assunto", "recebido_em", "tipo_email", "corpo_email")
    e = on_date(optional_filters(e, tipo_email=tipo_email), "recebido_em", data)
    p = protocolos.select("id_email", "id_protocolo", "id_resposta", "status", "acao_usuario",
                          "observacao", "criado_em", "ultima_atualizacao")
    rows = e.join(p, "id_email", "left")
    rows = optional_filters(rows, status=status)
    r = _replies(respostas, BOARD_REPLY_COLS, reply_key)
    rows = rows.withColumn("_lkey", F.col(reply_key))
    order = [desc_nf(F.coalesce(F.col("criado_em"), F.col("recebido_em"))),
             asc_nf("id_email"), asc_nf("id_protocolo")]
    if given(acao_ia):
        rows = rows.join(r, rows["_lkey"] == r["_rkey"], "left").drop("_rkey")
        rows = rows.filter(F.col("acao_sugerida") == F.lit(acao_ia))
        page = top_k(rows, order, limite)
    else:
        page = materialize_page(top_k(rows, order, limite), limite)
        page = left_join_bounded(page, r, "_lkey", "_rkey", limite)
        # Re-cut the (small) joined page so an outer limit never reaches inside it.
        page = top_k(page, order, limite)
    return materialize_page(page.drop("_lkey"), limite)


def attachments_of(page: DataFrame, anexos: DataFrame, max_rows: int | None) -> DataFrame:
    """Attachment rows of the mails on a page (long form, no nesting).

    One row per (page row, attachment); page rows without attachments keep
    one row with NULL attachment columns. The page is broadcast to the scan of
    the attachments, so a mail with very many stays spread over its tasks.
    """
    a = anexos.select(F.col("id_email").alias("_aid"), "id_anexo", "nome_arquivo",
                      "tipo_arquivo")
    return left_join_bounded(page, a, "id_email", "_aid", max_rows)


def attachment_counts(anexos: DataFrame) -> DataFrame:
    """Attachments per mail; partial aggregation keeps hot mails cheap."""
    return anexos.groupBy("id_email").agg(F.count(F.lit(1)).alias("n_anexos"))


def with_attachment_count(rows: DataFrame, anexos: DataFrame, max_rows: int | None) -> DataFrame:
    """Attachments per row; a page restricts them first, all rows meet the counts in one join."""
    found = anexos.select("id_email")
    if max_rows is None:
        out = rows.join(attachment_counts(found), "id_email", "left")
    else:
        counts = attachment_counts(restrict_to(found, rows, "id_email", max_rows))
        out = rows.join(bounded(counts, max_rows), "id_email", "left")
    return out.withColumn("n_anexos", F.coalesce(F.col("n_anexos"), F.lit(0)))


def nest_attachments(long_rows: DataFrame, key_cols: list[str]) -> DataFrame:
    """Presentation helper: fold the long form of ``attachments_of`` back into
    one row per page row with a sorted ``anexos`` array (empty when none).

    Only for pages (bounded by their limit); never for whole tables.
    """
    att = F.struct("id_anexo", "nome_arquivo", "tipo_arquivo")
    other = [c for c in long_rows.columns
             if c not in key_cols and c not in ("id_anexo", "nome_arquivo", "tipo_arquivo")]
    return (long_rows.groupBy(*key_cols)
            .agg(*[F.first(c, ignorenulls=True).alias(c) for c in other],
                 F.array_sort(F.filter(F.collect_list(att), lambda x: x["id_anexo"].isNotNull()))
                 .alias("anexos")))


# -- A2 A3 -------------------------------------------------------------------
def board_facets(board: DataFrame) -> DataFrame:
    """A2: distinct non-empty suggested actions and mail types of the rows."""
    acts = board.select(F.lit("acao_sugerida").alias("faceta"),
                        F.col("acao_sugerida").alias("valor"))
    types = board.select(F.lit("tipo_email").alias("faceta"), F.col("tipo_email").alias("valor"))
    out = acts.unionByName(types).filter(F.col("valor").isNotNull() & (F.col("valor") != ""))
    out = out.distinct()
    return out.withColumn("rotulo", F.when(F.col("faceta") == "tipo_email",
                                           capitalize_first("valor")).otherwise(F.col("valor")))


def board_count(board: DataFrame) -> DataFrame:
    """A3: number of rows for the current filter."""
    return board.agg(F.count(F.lit(1)).alias("total"))


# -- P4 T4 -------------------------------------------------------------------
def report_rows(emails: DataFrame, protocolos: DataFrame, respostas: DataFrame,
                data_inicio=None, data_fim=None, status=None, tipo_email=DEFAULT_TYPE,
                reply_key: str = "id_resposta", sort: bool = True, tribunal: str | None = None) -> DataFrame:
    """Cases in a received-date range with mail and reply fields.

    ``tribunal`` (P14) keeps the cases whose reply names a case number of that
    court (``8.26``); the filter is on the replies, before their join.

    Fully sorted (newest case first) only when ``sort``; an export sink
    should pass ``sort=False`` and partition the files instead.
    """
    e = emails.select("id_email", "assunto", "remetente", "recebido_em", "tipo_email")
    e = in_date_range(optional_filters(e, tipo_email=tipo_email), "recebido_em",
                      data_inicio, data_fim)
    p = optional_filters(protocolos, status=status)
    rows = p.join(e, "id_email", "inner")
    r = _replies(respostas, ("tipo_resposta", "processo", "opaj"), reply_key)
    if tribunal:
        r = r.where(court("processo") == tribunal)
    rows = rows.join(r, rows[reply_key] == r["_rkey"], "inner" if tribunal else "left").drop("_rkey")
    if sort:
        rows = rows.orderBy(desc_nf("criado_em"), asc_nf("id_protocolo"))
    return rows


# -- P8 P9 -------------------------------------------------------------------
def first_attachment(anexos: DataFrame) -> DataFrame:
    """Lowest-id attachment per mail (min over a struct: partial aggregate)."""
    first = F.min(F.struct("id_anexo", "nome_arquivo", "tipo_arquivo")).alias("_a")
    return (anexos.groupBy("id_email").agg(first)
            .select("id_email", F.col("_a.id_anexo").alias("anexo_id"),
                    F.col("_a.nome_arquivo").alias("anexo_nome_arquivo"),
                    F.col("_a.tipo_arquivo").alias("anexo_tipo_arquivo")))


def case_flat_detail(ids: DataFrame, emails: DataFrame, protocolos: DataFrame,
                     respostas: DataFrame, anexos: DataFrame,
                     max_ids: int | None = None) -> DataFrame:
    """Detail rows for a batch of case ids (missing ids give no row).

    Case, its mail, its reply and its first attachment. Names are explicit:
    reply columns carry ``resposta_``, attachment columns ``anexo_``.
    """
    p = restrict_to(protocolos, ids, "id_protocolo", max_ids)
    e = emails.select("id_email", "assunto", "remetente", "corpo_email", "recebido_em")
    rows = p.join(e, "id_email", "inner")
    r = respostas.select(F.col("id_resposta").alias("_rkey"),
                         *[F.col(c).alias("resposta_" + c) for c in REPLY_COLS])
    rows = rows.join(r, rows["id_resposta"] == r["_rkey"], "left").drop("_rkey")
    a = first_attachment(restrict_to(anexos, rows, "id_email", max_ids))
    return rows.join(a, "id_email", "left")


# -- J10 J11 J12 J13 ---------------------------------------------------------
def case_detail(emails: DataFrame, respostas: DataFrame, anexos: DataFrame,
                protocolos: DataFrame) -> DataFrame:
    """J10 (per-mail summary form): each mail with the number of its replies,
    attachments and cases and the newest case status.

    Each side is pre-aggregated per mail before the join, so sides never
    multiply and hot mails are combined map-side.
    """
    r = respostas.groupBy("id_email").agg(F.count(F.lit(1)).alias("n_respostas"))
    a = attachment_counts(anexos)
    p = protocolos.groupBy("id_email").agg(
        F.count(F.lit(1)).alias("n_protocolos"),
        F.max_by("status", F.struct(F.col("criado_em"), F.col("id_protocolo")))
        .alias("status_recente"))
    e = emails.select("id_email", "assunto", "remetente", "recebido_em", "tipo_email")
    out = e.join(r, "id_email", "left").join(a, "id_email", "left").join(p, "id_email", "left")
    return out.na.fill(0, ["n_respostas", "n_anexos", "n_protocolos"])


DETAIL_SECTIONS = ("email", "anexo", "resposta", "protocolo")


def case_detail_rows(emails: DataFrame, respostas: DataFrame, anexos: DataFrame, protocolos: DataFrame,
                     ids: DataFrame | None = None, max_ids: int | None = None) -> DataFrame:
    """The case detail as rows of four kinds: the mail, its attachments, replies and cases.

    ``secao`` names the kind, ``id`` the row; columns of other kinds are NULL.
    Ordered by mail, kind and id through range partitioning on all three, so
    a mail with very many rows is spread over tasks. ``ids`` (``id_email``)
    restricts every side before the union; attachments, replies and cases of
    unknown mails give no row.
    """
    if ids is not None:
        emails, respostas, anexos, protocolos = (
            restrict_to(df, ids, "id_email", max_ids) for df in (emails, respostas, anexos, protocolos))
    known = emails.select("id_email").where("id_email IS NOT NULL").distinct()

    def part(df: DataFrame, secao: str, key: str, *cols) -> DataFrame:
        return df.select("id_email", F.lit(DETAIL_SECTIONS.index(secao)).alias("_ordem"), F.lit(secao).alias("secao"),
                         F.col(key).cast("long").alias("id"), *cols)

    sides = [part(respostas, "resposta", "id_resposta", "status_final", "processo", "opaj"),
             part(anexos, "anexo", "id_anexo", "nome_arquivo", "tipo_arquivo"),
             part(protocolos, "protocolo", "id_protocolo", "acao_usuario",
                  F.col("usuario_protocolo").alias("usuario"), F.coalesce("protocolado_em", "criado_em").alias("data_registro"),
                  F.col("recibo_protocolo").alias("nome_recibo"))]
    rows = part(emails, "email", "id_email", "assunto", "remetente", "recebido_em", "corpo_email")
    for side in sides:
        rows = rows.unionByName(side.join(known, "id_email", "left_semi"), allowMissingColumns=True)
    return rows.orderBy("id_email", "_ordem", "id").drop("_ordem")


def filed_cases(emails: DataFrame, protocolos: DataFrame, respostas: DataFrame,
                anexos: DataFrame, reply_key: str = "id_resposta") -> DataFrame:
    """Cases marked as filed, with mail, reply status and attachment count."""
    p = protocolos.filter(F.col("acao_usuario") == "protocolado").select(
        "id_protocolo", "id_email", "id_resposta", "protocolado_em", "usuario_protocolo",
        "recibo_protocolo")
    e = emails.select("id_email", "assunto", "remetente", "recebido_em")
    rows = p.join(e, "id_email", "inner")
    r = _replies(respostas, ("status_final",), reply_key)
    rows = rows.join(r, rows[reply_key] == r["_rkey"], "left").drop("_rkey")
    return with_attachment_count(rows, anexos, None)


def reported_cases(emails: DataFrame, protocolos: DataFrame, respostas: DataFrame,
                   anexos: DataFrame, divergencias: DataFrame,
                   reply_key: str = "id_resposta") -> DataFrame:
    """Reported problems with their case, mail and reply status."""
    d = divergencias.select("id_divergencia", "id_protocolo", "usuario", "motivo_manual",
                            F.col("observacao").alias("observacao_divergencia"),
                            "data_registro")
    p = protocolos.select("id_protocolo", "id_email", "id_resposta", "status")
    e = emails.select("id_email", "assunto", "remetente", "recebido_em")
    rows = d.join(p, "id_protocolo", "inner").join(e, "id_email", "inner")
    r = _replies(respostas, ("status_final",), reply_key)
    rows = rows.join(r, rows[reply_key] == r["_rkey"], "left").drop("_rkey")
    return with_attachment_count(rows, anexos, None)


def attachment_names(anexos: DataFrame) -> DataFrame:
    """All attachment names per mail (array and ', '-joined text), in id order.

    The group is one mail's attachments -- bounded by the mail system's
    message-size limit, not by table size -- and it is built only for the
    mails that need a verdict request.
    """
    pairs = F.array_sort(F.collect_list(F.struct("id_anexo", "nome_arquivo")))
    grouped = anexos.groupBy("id_email").agg(pairs.alias("_p"), F.count(F.lit(1)).alias("n_anexos"))
    names = F.transform(F.col("_p"), lambda x: x["nome_arquivo"])
    return grouped.select("id_email", names.alias("nomes_anexos"),
                          F.array_join(names, ", ").alias("nomes_texto"), "n_anexos")


def attachment_name_rows(anexos: DataFrame) -> DataFrame:
    """J13 in long form: each attachment name with its position in its mail.

    Rows of one mail are numbered across tasks (``rank_within``), so a mail of
    any number of attachments is neither one task's work nor one row.
    """
    ranked = rank_within(anexos.select("id_email", "id_anexo", "nome_arquivo"), "id_email",
                         [F.col("id_anexo"), F.col("nome_arquivo")])
    return ranked.select("id_email", "posicao", "id_anexo", "nome_arquivo")


# -- J8 J9 P12 ---------------------------------------------------------------
def reply_by_attachment(requests: DataFrame, respostas: DataFrame) -> DataFrame:
    """The (lowest) reply id referring to each requested attachment id."""
    r = (respostas.select("id_anexo", "id_resposta").where(F.col("id_anexo").isNotNull())
         .groupBy("id_anexo").agg(F.min("id_resposta").alias("id_resposta")))
    return requests.select("id_anexo").join(r, "id_anexo", "left")


def active_users(usuarios: DataFrame) -> DataFrame:
    """Users that may act (present and active)."""
    return usuarios.filter(F.col("ativo") == F.lit(True)).select("username", "nome", "perfil")


def known_user_filings(protocolos: DataFrame, usuarios: DataFrame, known: bool = True) -> DataFrame:
    """Filed cases whose filing user is an active user (``known=False``:
    filings by unknown or inactive users)."""
    users = active_users(usuarios).select(F.col("username").alias("usuario_protocolo"))
    filings = protocolos.filter(F.col("usuario_protocolo").isNotNull()).select(
        "id_protocolo", "id_email", "usuario_protocolo", "protocolado_em")
    return filings.join(users, "usuario_protocolo", "left_semi" if known else "left_anti")


# -- S3 ----------------------------------------------------------------------
def attachment_lookup(requests: DataFrame, anexos: DataFrame, conteudo: DataFrame,
                      with_bytes: bool = False) -> DataFrame:
    """S3: answer a batch of attachment downloads.

    Found only when the attachment exists *and* has non-empty content. The
    MIME type defaults to ``application/octet-stream``. Bytes are joined in
    only when ``with_bytes`` (so listings never carry them); a size stored
    beside them (``tamanho``) is read in their place.
    """
    req = requests.select("id_anexo").distinct()
    meta = anexos.select("id_anexo", "nome_arquivo", "tipo_arquivo", F.lit(True).alias("_m"))
    size = F.col("tamanho") if "tamanho" in conteudo.columns else F.length("conteudo")
    c = conteudo.select("id_anexo", size.alias("tamanho"),
                        *(["conteudo"] if with_bytes else []))
    out = req.join(meta, "id_anexo", "left").join(c, "id_anexo", "left")
    size = F.coalesce(F.col("tamanho"), F.lit(0))
    return out.select(
        "id_anexo", "nome_arquivo",
        F.coalesce(F.nullif(F.col("tipo_arquivo"), F.lit("")),
                   F.lit("application/octet-stream")).alias("tipo_arquivo"),
        size.alias("tamanho"),
        *(["conteudo"] if with_bytes else []),
        F.when(F.col("_m").isNull(), F.lit("anexo_nao_encontrado"))
         .when(size == 0, F.lit("conteudo_vazio"))
         .otherwise(F.lit("ok")).alias("resultado"))
