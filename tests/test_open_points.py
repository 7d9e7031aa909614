"""Sender headers, repeated JSON keys, courts, names of hot mails, stored sizes."""

from email.utils import parseaddr

from pyspark.sql import functions as F

from mailflow.functions import extract as X
from mailflow.functions import verdict as V
from mailflow.operators import boards as B
from mailflow.operators import capture as K
from mailflow.operators import validation as VA

HEADERS = ["a@b.c", " a@b.c ", "Name <a@b.c>", "a@b.c (Name)", "(note) a@b.c", "a@b.c (one (two))", '"x <y@z>" <a@b.c>',
           '"x \\" <y@z>" <a@b.c>', "Name (a) <a@b.c>", "Name <>", "", '"a b"@c.d']


def test_addresses_are_those_of_the_mail_library(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HEADERS)], "i int, h string")
    got = {r.i: r.a for r in df.select("i", K.address_part("h").alias("a")).collect()}
    for i, h in enumerate(HEADERS):
        if h != "Name <>":
            assert got[i] == parseaddr(h)[1], h
    none = spark.createDataFrame([(None,)], "h string")
    assert none.select(K.address_part("h").alias("a")).first().a is None


def test_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([(1, '{"valido": true, "valido": false, "motivo": "a", "motivo": "b"}'), (2, '{"valido": true')],
                               "id_email long, conteudo string")
    got = {r.id_email: (r.valido, r.motivo, r.erro_ia) for r in V.parse_verdict(df).collect()}
    assert got[1] == (False, "b", None) and got[2][0] is None and got[2][2] == V.DECODE_ERROR


def test_texts_with_a_time_need_no_named_order(spark):
    req = spark.createDataFrame([(1,)], "id_email long")
    texts = spark.createDataFrame([(1, '{"acao_sugerida": "z"}', 1), (1, '{"acao_sugerida": "a"}', 2)],
                                  "id_email long, conteudo string, seq long")
    assert VA.verdicts_from_text(req, texts).first().acao_sugerida == "a"


def test_court(spark):
    df = spark.createDataFrame([("0001234-55.1998.8.26.0100",), ("00012345519988260100",), ("123456",), ("",), (None,)], "p string")
    assert [r.c for r in df.select(X.court("p").alias("c")).collect()] == ["8.26", "8.26", None, None, None]


def test_report_of_one_court(spark, tables):
    t = tables
    other = t.respostas.withColumn("processo", F.when(F.col("id_email") % 2 == 0, F.regexp_replace("processo", r"\.8\.26\.", ".4.03."))
                                   .otherwise(F.col("processo")))
    rows = lambda c: B.report_rows(t.emails, t.protocolos, other, tribunal=c, sort=False)
    one, two = rows("8.26").count(), rows("4.03").count()
    every = B.report_rows(t.emails, t.protocolos, other, sort=False).where("processo is not null").count()
    assert one and two and one + two == every and rows("9.99").count() == 0


def test_names_of_a_hot_mail_are_rows(spark):
    data = [(1, i, f"n{i}") for i in range(500)] + [(m, m * 1000, "x") for m in range(2, 200)] + [(None, 9_999_999, None)]
    df = spark.createDataFrame(data, "id_email long, id_anexo long, nome_arquivo string")
    got = B.attachment_name_rows(df).collect()
    assert len(got) == len(data)
    assert sorted(r.posicao for r in got if r.id_email == 1) == list(range(1, 501))
    assert all(r.posicao == r.id_anexo + 1 for r in got if r.id_email == 1)
    assert all(r.posicao == 1 for r in got if r.id_email != 1)


def test_stored_sizes_leave_the_bytes_alone(spark, scratch):
    c = spark.createDataFrame([(1, bytearray(b"abc"), 3), (2, bytearray(b""), 0)], "id_anexo long, conteudo binary, tamanho int")
    c.write.parquet(scratch + "/c")
    meta = spark.createDataFrame([(1, "a", ""), (2, "b", "t/x")], "id_anexo long, nome_arquivo string, tipo_arquivo string")
    ask = spark.createDataFrame([(1,), (2,), (3,)], "id_anexo long")
    found = B.attachment_lookup(ask, meta, spark.read.parquet(scratch + "/c"))
    assert {r.id_anexo: (r.tamanho, r.resultado) for r in found.collect()} == {
        1: (3, "ok"), 2: (0, "conteudo_vazio"), 3: (0, "anexo_nao_encontrado")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "conteudo:binary" not in plan
    plain = B.attachment_lookup(ask, meta, c.drop("tamanho"))
    assert sorted(plain.collect()) == sorted(found.collect())
