"""Lost mails, doubled verdicts, forwarded bodies and swallowed errors."""

import pytest

from mailflow.operators import capture as K
from mailflow.operators import upsert as U
from mailflow.operators import validation as VA
from mailflow.session import _local_folder
from mailflow.sources.mailparse import parse_raw_mail, with_fallback_id
from mailflow.streaming.capture import _stored

TO = "a@b.c"


def test_mails_without_an_id_are_kept_apart(spark):
    landed = spark.createDataFrame(
        [(1, None, TO, "um", None), (2, None, TO, "dois", None), (3, None, TO, "um", None), (4, "<x>", TO, "x", "bad"),
         (5, "<x>", TO, "x", None), (6, "<y>", "outro@b.c", "y", None)],
        "seq long, message_id string, remetente string, corpo_email string, erro string")
    existing = spark.createDataFrame([("<z>",)], "message_id string")
    new = K.new_messages(landed.where("erro is null"), existing, TO)
    assert sorted(r.seq for r in new.collect()) == [1, 2, 5]
    keys = K.new_keys(landed.where("erro is null"), existing, TO)
    assert sorted(map(tuple, keys.collect())) == sorted((r.message_id, r.seq) for r in new.collect())
    got = {r.seq: r.resultado for r in K.outcomes(landed, existing, TO, "erro").collect()}
    assert got == {1: "salvo", 2: "salvo", 3: "duplicado", 4: "falha", 5: "salvo", 6: "ignorado"}
    assert K.summary(landed, existing, TO, "erro").first().asDict() == {
        "salvos": 3, "duplicados": 1, "falhas": 1, "ignorados": 1}
    again = K.new_messages(landed.where("erro is null"), new, TO)
    assert again.count() == 0


def test_last_of_two_verdicts_counts(spark):
    req = spark.createDataFrame([(1,), (2,)], "id_email long")
    texts = spark.createDataFrame([(1, '{"acao_sugerida": "b"}', 1), (1, '{"acao_sugerida": "a"}', 2), (2, "x", 1)],
                                  "id_email long, conteudo string, em int")
    got = {r.id_email: r.acao_sugerida for r in VA.verdicts_from_text(req, texts, "em").collect()}
    assert got == {1: "a", 2: "aguardar"}
    assert VA.verdicts_from_text(req, texts).count() == 2


def test_upsert_fails_on_a_repeated_source_key(spark):
    target = spark.createDataFrame([(1, "a", "t")], "k long, v string, w string")
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k long, v string")
    for insert in (True, False):
        assert U.upsert(target, twice.where("v = 'x'"), "k", ["v"], insert=insert).count() == 1 + insert
    with pytest.raises(Exception, match="more than one source row"):
        U.upsert(target, twice, "k", ["v"]).collect()


def test_forwarded_text_is_no_body_and_ids_come_from_content(spark):
    mail = (b'From: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="B"\r\n\r\n'
            b"--B\r\nContent-Type: text/html\r\n\r\n<p>fora</p>\r\n"
            b"--B\r\nContent-Type: message/rfc822\r\n\r\nFrom: x@y.z\r\nContent-Type: text/plain\r\n\r\ndentro\r\n--B--\r\n")
    raw = spark.createDataFrame([("a/1", bytearray(mail)), ("b/2", bytearray(mail)), ("c/3", bytearray(mail + b"\r\n"))],
                                "path string, content binary")
    rows = {r.path: r for r in with_fallback_id(parse_raw_mail(raw)).collect()}
    assert {r.corpo_email for r in rows.values()} == {"<p>fora</p>"}
    assert rows["a/1"].message_id == rows["b/2"].message_id != rows["c/3"].message_id


def test_only_a_missing_store_counts_as_empty(spark, scratch):
    rows = spark.createDataFrame([(1,)], "seq long")
    assert _stored(spark, f"{scratch}/none", rows).count() == 0
    with pytest.raises(Exception, match="nosuchscheme"):
        _stored(spark, "nosuchscheme://x/y", rows)
    with pytest.raises(ValueError):
        _local_folder("spark://host:7077")
