"""Rule-based classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: classifier keywords, checked on the lower-cased subject ----
# Ordered rules; the first rule whose keywords occur decides. Accents matter.
MAIL_TYPE_RULES = (
    ("protocolo", ("ofício", "resposta")),
    ("cancelamento", ("cancelamento", "desistência")),
    ("comunicacao", ("comunicação", "comunicado")),
)
MAIL_TYPE_DEFAULT = "outro"

# Attachment-name keywords (names are lower-cased first).
DRAFT_NAME_WORDS = ("minuta", "resposta", "oficio")
SIGNATURE_NAME_WORDS = ("assinatura", "certificado")
BLOCK_WORD = "bloqueio"

# Status code -> display label; unknown codes show the code itself.
STATUS_LABELS = {
    "pending": "Pendente",
    "protocolado": "Protocolado",
    "invalid": "Inválido IA",
    "incompleto": "Incompleto",
    "reportado": "Reportado",
    "revisao": "Em Revisão",
    "completed": "Concluído",
}

# Phrases in a body that announce an attachment.
MENTION_PHRASES = ("segue anexo", "documento em anexo")
# -----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains_any(text: Column, words) -> Column:
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def mail_type(subject="assunto") -> Column:
    """ordered keyword rules on the lower-cased subject (body unused)."""
    s = F.lower(F.coalesce(_col(subject), F.lit("")))
    expr = None
    for label, words in MAIL_TYPE_RULES:
        cond = _contains_any(s, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(MAIL_TYPE_DEFAULT))


def attachment_flags_per_mail(anexos: DataFrame) -> DataFrame:
    """Per mail: does any attachment name look like a draft / signature /
    blocking proof, and how many attachments are not draft or signature.

    A plain aggregate with partial (map-side) combine, so a mail with a huge
    number of attachments is reduced inside each input task before the shuffle.
    """
    name = F.lower(F.coalesce(F.col("nome_arquivo"), F.lit("")))
    draft = _contains_any(name, DRAFT_NAME_WORDS)
    strict_draft = name.contains("minuta")
    sig = _contains_any(name, SIGNATURE_NAME_WORDS)
    other = ~(strict_draft | sig)
    return (anexos.groupBy("id_email")
            .agg(F.max(draft.cast("int")).alias("_draft"),
                 F.max(strict_draft.cast("int")).alias("_minuta"),
                 F.max(sig.cast("int")).alias("_sig"),
                 F.max(name.contains(BLOCK_WORD).cast("int")).alias("_bloq_name"),
                 F.sum(other.cast("int")).alias("_n_other"),
                 F.count(F.lit(1)).alias("_n_anexos")))


def _with_flags(mails: DataFrame, anexos: DataFrame) -> DataFrame:
    # Aggregate only the attachments of the mails at hand (semi join first).
    flags = attachment_flags_per_mail(anexos.join(mails.select("id_email"), "id_email",
                                                  "left_semi"))
    out = mails.join(flags, "id_email", "left")
    return out.na.fill(0, ["_draft", "_minuta", "_sig", "_bloq_name", "_n_other", "_n_anexos"])


def _missing(subject: Column, body: Column) -> Column:
    text = F.concat(F.lower(F.coalesce(subject, F.lit(""))), F.lit("\n"),
                    F.lower(F.coalesce(body, F.lit(""))))
    wants_block = text.contains(BLOCK_WORD)
    items = F.array(
        F.when(F.col("_draft") == 0, F.lit("minuta")),
        F.when(F.col("_sig") == 0, F.lit("assinatura")),
        F.when(wants_block & (F.col("_bloq_name") == 0), F.lit("bloqueio")),
    )
    return F.filter(items, lambda x: x.isNotNull())


def attachment_completeness(mails: DataFrame, anexos: DataFrame) -> DataFrame:
    """``faltantes`` (ordered missing list) and ``status_contexto``.

    Draft is missing unless a name has minuta/resposta/oficio; signature unless
    assinatura/certificado; blocking proof when subject or body mention it and
    no name does. ``incompleto`` when anything is missing, else ``completo``.
    """
    out = _with_flags(mails, anexos)
    out = out.withColumn("faltantes", _missing(F.col("assunto"), F.col("corpo_email")))
    out = out.withColumn("status_contexto",
                         F.when(F.size("faltantes") > 0, F.lit("incompleto"))
                         .otherwise(F.lit("completo")))
    return out.drop("_draft", "_minuta", "_sig", "_bloq_name", "_n_other", "_n_anexos")


def formal_rules(mails: DataFrame, anexos: DataFrame) -> DataFrame:
    """deterministic verdict in the shape of a parsed scorer verdict.

    Needs ``processo``, ``opaj``, ``identificador`` on ``mails`` (see
    ``extract.extract_fields``). When ``mails`` carries ``nomes_texto`` (all
    attachment names joined), identifiers are also looked up in the names.

    draft      = some name contains 'minuta'
    signature  = some name contains 'assinatura' or 'certificado'
    ids_ok     = every extracted identifier occurs in the names or the text
    mention_ok = the body announces no attachment, or there is an attachment
                 other than draft and signature
    acao       = rejeitar without draft and signature; protocolar when all
                 four hold; revisar otherwise.
    """
    with_names = "nomes_texto" in mails.columns
    out = _with_flags(mails, anexos)
    hay = F.lower(F.concat_ws("\n", F.coalesce(F.col("assunto"), F.lit("")),
                              F.coalesce(F.col("corpo_email"), F.lit("")),
                              *([F.coalesce(F.col("nomes_texto"), F.lit(""))]
                                if with_names else [])))
    ids_ok = F.lit(True)
    for c in ("processo", "opaj", "identificador"):
        ids_ok = ids_ok & (F.col(c).isNull() | hay.contains(F.lower(F.col(c))))
    body = F.lower(F.coalesce(F.col("corpo_email"), F.lit("")))
    mentions = _contains_any(body, MENTION_PHRASES)
    mention_ok = ~mentions | (F.col("_n_other") > 0)
    draft = F.col("_minuta") == 1
    sig = F.col("_sig") == 1
    acao = (F.when(~draft & ~sig, F.lit("rejeitar"))
            .when(draft & sig & ids_ok & mention_ok, F.lit("protocolar"))
            .otherwise(F.lit("revisar")))
    reasons = F.concat_ws("; ",
                          F.when(~draft, F.lit("minuta ausente")),
                          F.when(~sig, F.lit("comprovante de assinatura ausente")),
                          F.when(~ids_ok, F.lit("identificadores divergentes")),
                          F.when(~mention_ok, F.lit("anexo mencionado ausente")))
    out = (out.withColumn("acao_sugerida", acao)
              .withColumn("valido", acao == "protocolar")
              .withColumn("coerencia", ids_ok & mention_ok)
              .withColumn("campos_faltantes", _missing(F.col("assunto"), F.col("corpo_email")))
              .withColumn("motivo", F.when(reasons == "", F.lit("regras formais atendidas"))
                          .otherwise(reasons))
              .withColumn("erro_ia", F.lit(None).cast("string")))
    return out.drop("_draft", "_minuta", "_sig", "_bloq_name", "_n_other", "_n_anexos")


def status_label(status="status") -> Column:
    """display label of a status code; unknown codes pass through."""
    m = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    s = _col(status)
    return F.coalesce(F.try_element_at(m, s), s)


def fileable(status="status") -> Column:
    """May the case be filed (status pending/invalid/incompleto/revisao)."""
    return F.coalesce(_col(status).isin("pending", "invalid", "incompleto", "revisao"),
                      F.lit(False))


def has_suffix(name, suffix: str) -> Column:
    """P10: case-sensitive file suffix test; NULL or empty name -> false."""
    return F.coalesce(_col(name).endswith(suffix), F.lit(False))
