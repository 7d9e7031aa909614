"""Mail parsing on generated .eml files read with the binaryFile source."""

import os

from pyspark.sql import functions as F

from mailflow.sources.mailparse import parse_raw_mail, read_landed_mail, with_fallback_id

MULTIPART = (
    "From: Fulano <Respostas@Example.com>\r\n"
    "Subject: =?utf-8?b?UmVzcG9zdGEgZGUgT2bDrWNpbw==?=\r\n"
    "Message-ID: <m1@x>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\n"
    'Content-Type: multipart/mixed; boundary="BB"\r\n\r\n'
    "--BB\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n  corpo do texto  \r\n"
    "--BB\r\nContent-Type: application/pdf\r\n"
    'Content-Disposition: attachment; filename="minuta.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\n'
    "eHl6\r\n"
    "--BB\r\nContent-Type: application/zip\r\n"
    'Content-Disposition: attachment; filename="vazio.zip"\r\n\r\n\r\n'
    "--BB--\r\n")
HTML_ONLY = ("From: a@b.c\r\nSubject: html\r\nMessage-ID: <m2@x>\r\n"
             "Content-Type: text/html; charset=utf-8\r\n\r\n<p>Olá</p>\r\n")
NO_ID = "From: a@b.c\r\nSubject: sem id\r\n\r\ncorpo\r\n"


def _write(folder, name, text):
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write(text.encode("utf-8"))


def test_parse_generated_samples(spark, scratch):
    _write(scratch, "1.eml", MULTIPART)
    _write(scratch, "2.eml", HTML_ONLY)
    _write(scratch, "3.eml", NO_ID)
    _write(scratch, "ignore.txt", "not mail")
    parsed = with_fallback_id(parse_raw_mail(read_landed_mail(spark, scratch)))
    rows = {os.path.basename(r.path): r for r in parsed.collect()}
    assert set(rows) == {"1.eml", "2.eml", "3.eml"}
    m = rows["1.eml"]
    assert (m.message_id, m.remetente, m.assunto) == ("<m1@x>", "Respostas@Example.com", "Resposta de Ofício")
    assert m.corpo_email == "corpo do texto"
    assert [(a.nome_arquivo, bytes(a.conteudo)) for a in m.anexos] == [("minuta.pdf", b"xyz"), ("vazio.zip", b"")]
    assert m.recebido_em_raw.startswith("Mon, 01 Jan 2024")
    assert rows["2.eml"].corpo_email == "<p>Olá</p>" and rows["2.eml"].anexos == []
    assert rows["3.eml"].message_id.startswith("<hash-")
    saved = parsed.select(F.size(F.filter("anexos", lambda a: F.length(a["conteudo"]) > 0)).alias("n"))
    assert sorted(r.n for r in saved.collect()) == [0, 0, 1]
