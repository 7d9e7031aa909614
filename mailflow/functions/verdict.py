"""Verdict text -> typed decision (F16-F19) and the pluggable scorer hook.

Parsing runs JVM-side with ``try_parse_json`` / ``try_variant_get``; only the
optional external scorer (``score_with``) runs Python, batched through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: verdict defaults and routing vocabulary --------------------
FALLBACK_ACTION = "aguardar"
DECODE_ERROR = "json_decode_error"
BAD_JSON_REASON = "IA não respondeu em JSON válido. Conteúdo bruto: "
CALL_ERROR_REASON = "IA não executada — erro de API: "
BODY_PROMPT_CHARS = 800
# -----------------------------------------------------------------------------

VERDICT_FIELDS = ("valido", "campos_faltantes", "coerencia", "motivo", "acao_sugerida", "erro_ia")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def unfence(c) -> Column:
    """Strip, then drop a leading json fence and a trailing fence.

    A bare leading fence (without ``json``) is kept, so such text stays
    malformed -- the same rule the scorer's consumers have always applied.
    """
    s = strip_text(c)
    s = F.regexp_replace(s, r"(?U)^```json\s*", "")
    return F.regexp_replace(s, r"(?U)\s*```$", "")


def parse_verdict(df: DataFrame, text: str = "conteudo") -> DataFrame:
    """typed verdict columns from raw scorer text.

    Valid JSON objects give their fields (missing list defaults to empty);
    anything else -- bad JSON, or JSON that is not an object -- gives
    ``valido`` NULL, an empty missing list, action ``aguardar`` and the raw
    (stripped) text in the reason. Of a repeated key the last value counts
    where the session allows such keys (``session.BASE_CONF``).
    """
    # Parse once: the text is unfenced and parsed in one projection, the
    # fields are read from the parsed value in the next.
    staged = df.select("*", unfence(text).alias("_body")) \
               .withColumn("_v", F.try_parse_json(F.col("_body")))
    body, v = F.col("_body"), F.col("_v")
    ok = v.isNotNull() & body.startswith("{")
    get = lambda path, typ: F.try_variant_get(v, path, typ)
    missing = F.coalesce(get("$.campos_faltantes", "array<string>"),
                         F.array().cast("array<string>"))
    return staged.select(
        *df.columns,
        F.when(ok, get("$.valido", "boolean")).alias("valido"),
        F.when(ok, missing).otherwise(F.array().cast("array<string>")).alias("campos_faltantes"),
        F.when(ok, get("$.coerencia", "boolean")).alias("coerencia"),
        F.when(ok, get("$.motivo", "string"))
         .otherwise(F.concat(F.lit(BAD_JSON_REASON), body)).alias("motivo"),
        F.when(ok, get("$.acao_sugerida", "string"))
         .otherwise(F.lit(FALLBACK_ACTION)).alias("acao_sugerida"),
        F.when(ok, get("$.erro_ia", "string"))
         .otherwise(F.lit(DECODE_ERROR)).alias("erro_ia"),
    )


def route_verdict(df: DataFrame) -> DataFrame:
    """map a verdict onto reply/protocol columns.

    ``valido`` true -> ``pending``; false or NULL -> ``invalid``. The reason
    becomes the invalid-reason only when invalid; the action feeds
    ``tipo_resposta``, ``status_validacao`` and the protocol's user action.
    """
    valid = F.coalesce(F.col("valido"), F.lit(False))
    return df.select(
        "*",
        F.when(valid, F.lit("pending")).otherwise(F.lit("invalid")).alias("status"),
        F.when(valid, F.lit(None).cast("string")).otherwise(F.col("motivo")).alias("motivo_invalido"),
        F.col("motivo").alias("observacao"),
        F.col("motivo").alias("resumo_ia"),
        F.col("coerencia").alias("coerente"),
        F.col("campos_faltantes").alias("erros"),
        F.col("acao_sugerida").alias("tipo_resposta"),
        F.col("acao_sugerida").alias("status_validacao"),
        F.col("valido").alias("validado"),
    )


def fields_json(processo="processo", opaj="opaj", identificador="identificador") -> Column:
    """The extracted fields as a JSON object, NULL fields kept."""
    return F.to_json(F.struct(_col(processo).alias("processo"), _col(opaj).alias("opaj"),
                              _col(identificador).alias("identificador")),
                     {"ignoreNullFields": "false"})


def verdict_prompt(subject="assunto", body="corpo_email", names="nomes_texto",
                   fields="campos_json") -> Column:
    """F16: the request text handed to an external scorer (own wording).

    Subject, the first 800 characters of the body, attachment names and the
    extracted fields as JSON. Attachment texts are not available to the
    workflow, so none are sent.
    """
    return F.format_string(
        "Valide a resposta ao ofício.\nAssunto: %s\nCorpo: %s\nAnexos: %s\nCampos: %s\n"
        "Responda em JSON com valido, campos_faltantes, coerencia, motivo, acao_sugerida.",
        F.coalesce(_col(subject), F.lit("")),
        F.substring(F.coalesce(_col(body), F.lit("")), 1, BODY_PROMPT_CHARS),
        F.coalesce(_col(names), F.lit("")), _col(fields))


NO_ANSWER = "sem resposta do avaliador"


def score_with(df: DataFrame, scorer: Callable, key: str = "id_email",
               prompt: str = "prompt") -> DataFrame:
    """Run a caller-supplied scorer over Arrow batches (``mapInPandas``).

    ``scorer(pandas.DataFrame[key, prompt]) -> pandas.DataFrame[key, conteudo]``
    returns raw verdict text per row. A call that raises is repeated on halves
    of its rows down to single ones, so only rows that fail by themselves get
    the call-failure verdict (F18), whatever the size of a batch; a row that
    the scorer leaves out gets it too. ``n`` failing rows of a batch of ``m``
    cost about ``2 n log2 m`` calls more.
    Output: ``key, conteudo, erro_chamada`` -- feed it to ``parse_verdict``.
    """
    import pandas as pd

    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, conteudo string, erro_chamada string"

    def answered(rows):
        try:
            out = scorer(rows)
            texts = out.drop_duplicates(key).set_index(key)["conteudo"]
        except Exception as exc:  # noqa: BLE001 - the outcome is a column
            if len(rows) == 1:
                yield pd.DataFrame({key: rows[key], "conteudo": None, "erro_chamada": str(exc)})
                return
            half = len(rows) // 2
            yield from answered(rows.iloc[:half])
            yield from answered(rows.iloc[half:])
            return
        got = rows[key].map(texts)
        missing = ~rows[key].isin(texts.index)
        yield pd.DataFrame({key: rows[key], "conteudo": got.astype(object).where(got.notna(), None),
                            "erro_chamada": missing.map({True: NO_ANSWER, False: None})})

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield from answered(pdf[[key, prompt]])

    return df.select(key, prompt).mapInPandas(run, schema)


def parse_scored(df: DataFrame) -> DataFrame:
    """``parse_verdict`` plus F18: rows with a call error get the error verdict."""
    parsed = parse_verdict(df, "conteudo")
    err = F.col("erro_chamada")
    return parsed.select(
        *[c for c in df.columns],
        F.when(err.isNull(), F.col("valido")).alias("valido"),
        F.when(err.isNull(), F.col("campos_faltantes"))
         .otherwise(F.array().cast("array<string>")).alias("campos_faltantes"),
        F.when(err.isNull(), F.col("coerencia")).alias("coerencia"),
        F.when(err.isNull(), F.col("motivo"))
         .otherwise(F.concat(F.lit(CALL_ERROR_REASON), err)).alias("motivo"),
        F.when(err.isNull(), F.col("acao_sugerida"))
         .otherwise(F.lit(FALLBACK_ACTION)).alias("acao_sugerida"),
        F.when(err.isNull(), F.col("erro_ia")).otherwise(err).alias("erro_ia"),
    )


VERDICT_SCHEMA = T.StructType([
    T.StructField("valido", T.BooleanType()),
    T.StructField("campos_faltantes", T.ArrayType(T.StringType())),
    T.StructField("coerencia", T.BooleanType()),
    T.StructField("motivo", T.StringType()),
    T.StructField("acao_sugerida", T.StringType()),
    T.StructField("erro_ia", T.StringType()),
])
