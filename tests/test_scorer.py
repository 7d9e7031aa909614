"""The pluggable scorer hook (mapInPandas) and call-failure verdicts."""

from pyspark.sql import functions as F

from mailflow.functions import verdict as V


def test_score_with_and_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id_email long, prompt string")

    def good(pdf):
        out = pdf[["id_email"]].copy()
        out["conteudo"] = ['{"valido": true, "acao_sugerida": "protocolar"}'] * len(out)
        return out

    def bad(pdf):
        raise RuntimeError("timeout")

    ok = V.parse_scored(V.score_with(df, good)).orderBy("id_email").collect()
    assert [r.valido for r in ok] == [True, True]
    failed = V.parse_scored(V.score_with(df, bad)).orderBy("id_email").collect()
    assert all(r.valido is None and r.acao_sugerida == "aguardar" for r in failed)
    assert failed[0].motivo.endswith("timeout") and failed[0].erro_ia == "timeout"
    routed = V.route_verdict(V.parse_scored(V.score_with(df, bad)))
    assert {r.status for r in routed.select("status").collect()} == {"invalid"}


def test_prompt_parts(spark):
    df = spark.createDataFrame([("Assunto", "x" * 900, "a.pdf", None, "123", None)],
                               "assunto string, corpo_email string, nomes_texto string,"
                               " processo string, opaj string, identificador string")
    df = df.withColumn("campos_json", V.fields_json())
    r = df.select(V.verdict_prompt().alias("p"), "campos_json").first()
    assert r.campos_json == '{"processo":null,"opaj":"123","identificador":null}'
    assert "Corpo: " + "x" * 800 + "\n" in r.p and "x" * 801 not in r.p
    assert "Anexos: a.pdf" in r.p and F is not None
