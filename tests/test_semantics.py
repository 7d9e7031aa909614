"""Small literal DataFrames for each rule that is easy to get wrong."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from mailflow import schemas
from mailflow.functions import classify as C
from mailflow.functions import display as D
from mailflow.functions import extract as X
from mailflow.functions import verdict as V
from mailflow.operators import boards as B
from mailflow.operators import capture as K
from mailflow.operators import upsert as U
from mailflow.sources.tables import conform

TS = dt.datetime(2024, 1, 1, 10, 0, 0)


def _mails(spark, rows):
    return conform(spark.createDataFrame(rows), schemas.EMAILS)


def _cases(spark, rows):
    return conform(spark.createDataFrame(rows), schemas.PROTOCOLOS)


def test_pending_count_excludes_null_status_and_closed(spark):
    mails = _mails(spark, [Row(id_email=1, tipo_email="protocolo"), Row(id_email=2, tipo_email="protocolo")])
    cases = _cases(spark, [Row(id_protocolo=10, id_email=1, status=None),
                           Row(id_protocolo=11, id_email=1, status="pending"),
                           Row(id_protocolo=12, id_email=2, status="cancelado"),
                           Row(id_protocolo=13, id_email=2, status="invalid")])
    assert B.pending_count(mails, cases).first().total == 2
    assert B.pending_count(mails, cases, status="cancelado").first().total == 1


def test_empty_string_parameter_means_no_filter(spark):
    mails = _mails(spark, [Row(id_email=1, tipo_email="protocolo", recebido_em=TS),
                           Row(id_email=2, tipo_email="outro", recebido_em=TS)])
    cases = _cases(spark, [Row(id_protocolo=10, id_email=1), Row(id_protocolo=11, id_email=2)])
    resp = conform(spark.createDataFrame([Row(id_resposta=1)]), schemas.RESPOSTAS)
    assert B.case_board(mails, cases, resp, tipo_email="").count() == 2
    assert B.case_board(mails, cases, resp).count() == 1
    assert B.case_board(mails, cases, resp, status="").count() == 1


def test_status_filter_drops_mails_without_case(spark):
    mails = _mails(spark, [Row(id_email=1, tipo_email="protocolo", recebido_em=TS),
                           Row(id_email=2, tipo_email="protocolo", recebido_em=TS)])
    cases = _cases(spark, [Row(id_protocolo=10, id_email=1, status="pending")])
    resp = conform(spark.createDataFrame([Row(id_resposta=1)]), schemas.RESPOSTAS)
    assert B.case_board(mails, cases, resp).count() == 2
    assert [r.id_email for r in B.case_board(mails, cases, resp, status="pending").collect()] == [1]


def test_desc_puts_nulls_first_and_limit_counts_fanout(spark):
    mails = _mails(spark, [Row(id_email=i, tipo_email="protocolo", recebido_em=TS) for i in (1, 2, 3)])
    cases = _cases(spark, [Row(id_protocolo=10, id_email=1, criado_em=TS),
                           Row(id_protocolo=11, id_email=2, criado_em=None),
                           Row(id_protocolo=12, id_email=3, criado_em=TS + dt.timedelta(days=1))])
    resp = conform(spark.createDataFrame([Row(id_resposta=1)]), schemas.RESPOSTAS)
    att = conform(spark.createDataFrame([Row(id_anexo=100, id_email=2, nome_arquivo="a.zip"),
                                         Row(id_anexo=101, id_email=2, nome_arquivo="b.PDF"),
                                         Row(id_anexo=102, id_email=3, nome_arquivo="c.pdf")]),
                  schemas.ANEXOS_EMAIL)
    rows = B.protocol_listing(mails, cases, resp, att, limite=3).orderBy(
        F.col("criado_em").desc_nulls_first(), "id_protocolo", "id_anexo").collect()
    assert [(r.id_protocolo, r.id_anexo) for r in rows] == [(11, 100), (11, 101), (12, 102)]
    assert [(r.tem_zip, r.tem_pdf) for r in rows] == [(True, False), (False, False), (False, True)]


def test_extraction_rules(spark):
    df = spark.createDataFrame([
        Row(t="Resposta 1234567-89.2020.8.26.0100 OPAJ – 42 fnda:1234567 x"),
        Row(t="só dígitos 99999999 e opaj/7"),
        Row(t="nada aqui"),
        Row(t=None),
    ])
    out = df.select(X.case_number("t").alias("p"), X.order_number("t").alias("o"),
                    X.identifier("t").alias("i"), X.case_kind("t").alias("k")).collect()
    assert out[0] == Row(p="1234567-89.2020.8.26.0100", o="42", i="FNDA-1234567", k="CNJ")
    assert out[1] == Row(p="99999999", o="7", i=None, k="ADMINISTRATIVO")
    assert out[2] == Row(p=None, o=None, i=None, k=None)
    assert out[3] == Row(p=None, o=None, i=None, k=None)


def test_final_status_is_last_match(spark):
    df = spark.createDataFrame([Row(s="Resposta parcial e depois resposta final"),
                                Row(s="pedido de dilação"), Row(s="nenhum")])
    got = [r.f for r in df.select(X.final_status("s").alias("f")).collect()]
    assert got == ["RESPOSTA FINAL", "DILAÇÃO", None]


def test_strict_forms_return_empty_string(spark):
    df = spark.createDataFrame([Row(t="proc 1234567-89.2020.8.26.0100 op 7654321"), Row(t="x")])
    got = df.select(X.strict_case_number("t").alias("p"), X.strict_order_number("t").alias("o")).collect()
    assert got[0] == Row(p="1234567-89.2020.8.26.0100", o="1234567")
    assert got[1] == Row(p="", o="")


def test_classifier_is_ordered_and_accent_sensitive(spark):
    df = spark.createDataFrame([Row(s="Ofício de cancelamento"), Row(s="Oficio sem acento"),
                                Row(s="Comunicação"), Row(s=None), Row(s="DESISTÊNCIA")])
    got = [r.k for r in df.select(C.mail_type("s").alias("k")).collect()]
    assert got == ["protocolo", "outro", "comunicacao", "outro", "cancelamento"]


def test_suffix_flags_are_case_sensitive(spark):
    df = spark.createDataFrame([Row(n="a.pdf"), Row(n="a.PDF"), Row(n=""), Row(n=None)],
                               "n string")
    got = [r.f for r in df.select(C.has_suffix("n", ".pdf").alias("f")).collect()]
    assert got == [True, False, False, False]


def test_verdict_parse_fences_and_malformed(spark):
    df = spark.createDataFrame([
        Row(c='  ```json\n{"valido": true, "acao_sugerida": "protocolar"}\n```  '),
        Row(c='```\n{"valido": true}\n```'),
        Row(c='[1, 2]'),
        Row(c='{"valido": false, "motivo": "x"}'),
    ])
    rows = V.parse_verdict(df, "c").collect()
    assert rows[0].valido is True and rows[0].acao_sugerida == "protocolar"
    assert rows[0].campos_faltantes == []
    assert rows[1].valido is None and rows[1].acao_sugerida == "aguardar"
    assert rows[1].motivo.endswith('```\n{"valido": true}')
    assert rows[2].valido is None and rows[2].erro_ia == "json_decode_error"
    assert rows[3].valido is False and rows[3].acao_sugerida is None


def test_null_verdict_routes_to_invalid(spark):
    df = spark.createDataFrame([Row(valido=None, motivo="m", coerencia=None,
                                    campos_faltantes=[], acao_sugerida="aguardar"),
                                Row(valido=True, motivo="ok", coerencia=True,
                                    campos_faltantes=[], acao_sugerida="protocolar")],
                               "valido boolean, motivo string, coerencia boolean, "
                               "campos_faltantes array<string>, acao_sugerida string")
    r = V.route_verdict(df).collect()
    assert (r[0].status, r[0].motivo_invalido) == ("invalid", "m")
    assert (r[1].status, r[1].motivo_invalido) == ("pending", None)


def test_upsert_new_null_overwrites_and_keeps_unlisted(spark):
    target = spark.createDataFrame([Row(k=1, a="old", b="keep"), Row(k=2, a="x", b="y")])
    source = spark.createDataFrame([Row(k=1, a=None), Row(k=3, a="new")], "k long, a string")
    out = {r.k: r for r in U.upsert(target, source, "k", ["a"]).collect()}
    assert out[1].a is None and out[1].b == "keep"
    assert out[2].a == "x"
    assert out[3].a == "new" and out[3].b is None
    only_update = U.upsert(target, source, "k", ["a"], insert=False)
    assert sorted(r.k for r in only_update.collect()) == [1, 2]


def test_last_and_first_per_key(spark):
    df = spark.createDataFrame([Row(k="a", t=1, v="x"), Row(k="a", t=3, v="y"),
                                Row(k="b", t=2, v="z")])
    last = {r.k: r.v for r in U.last_per_key(df, "k", [F.col("t")]).collect()}
    first = {r.k: r.v for r in U.first_per_key(df, "k", [F.col("t")]).collect()}
    assert last == {"a": "y", "b": "z"} and first == {"a": "x", "b": "z"}


def test_quality_attachment_test_comes_first(spark):
    new = spark.createDataFrame([Row(seq=1, message_id="<a>", corpo_email="x", recebido_em=TS),
                                 Row(seq=2, message_id="<b>", corpo_email="curto", recebido_em=TS),
                                 Row(seq=3, message_id="<c>", corpo_email="texto longo o bastante aqui",
                                     recebido_em=TS)])
    parts = spark.createDataFrame([Row(seq=2, tamanho=5), Row(seq=3, tamanho=5), Row(seq=1, tamanho=0)])
    got = {r.seq: r.status for r in K.quality_failures(new, parts).collect()}
    assert got == {1: "sem_anexo", 2: "fora_do_padrao"}


def test_sender_address_part(spark):
    df = spark.createDataFrame([Row(remetente="Nome <Respostas@Example.com>"),
                                Row(remetente=" respostas@example.com "), Row(remetente="x@y.z")])
    assert K.sender_filter(df, "respostas@example.com").count() == 2


def test_display_fallbacks(spark):
    df = spark.createDataFrame([Row(id_resposta=0, id_protocolo=5, id_email=9, status_validacao="",
                                    status=None, data_chegada=None, criado_em=TS, assunto="a" * 100)],
                               "id_resposta long, id_protocolo long, id_email long, status_validacao string,"
                               " status string, data_chegada timestamp_ntz, criado_em timestamp_ntz,"
                               " assunto string")
    r = df.select(D.display_id().alias("i"), D.display_status().alias("s"),
                  D.format_timestamp(D.display_time()).alias("t"),
                  F.length(D.subject_cut()).alias("n"), D.capitalize_first(F.lit("protocolo")).alias("c"),
                  C.status_label(F.lit("invalid")).alias("l"), C.status_label(F.lit("xyz")).alias("u")).first()
    assert (r.i, r.s, r.t, r.n, r.c, r.l, r.u) == (5, "Aguardando", "01/01/2024, 10:00:00", 80,
                                                   "Protocolo", "Inválido IA", "xyz")


def test_received_time_parse_and_fallback(spark):
    df = spark.createDataFrame([Row(h="Mon, 01 Jan 2024 10:00:00 -0300"),
                                Row(h="01 Jan 2024 10:00:00 +0000"), Row(h=None)], "h string")
    fb = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    got = [r.t for r in df.select(X.received_time("h", fb).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 13, 0), dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1)]
