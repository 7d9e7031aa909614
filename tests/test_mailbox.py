"""Capture of raw mail: files and bundles, batch and stream, replay, pause, progress, bounded state."""

import os

import pytest
from pyspark.sql import functions as F

from mailflow.operators import mailbox as M
from mailflow.sources.mailparse import parse_mailbox, read_landed_mail, split_mailbox
from mailflow.streaming import mailbox as S

ME = "respostas@example.com"


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def mail(n, mid="", body="corpo com mais de vinte letras", sender="Respostas@Example.com", parts=1, charset="utf-8", head=""):
    lines = [f"From: Alguem <{sender}>", f"Subject: Resposta {n}", "Date: Thu, 02 May 1996 10:00:00 -0300",
             "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="b"']
    if mid is not None:
        lines.append(f"Message-ID: {mid or f'<m{n}@x>'}")
    lines += [head] if head else []
    lines += ["", "--b", f'Content-Type: text/plain; charset="{charset}"', "", body]
    for i in range(parts):
        lines += ["--b", "Content-Type: application/pdf", *([f'Content-Disposition: attachment; filename="a{i}.pdf"'] if i else []),
                  "", f"dados {i}" if i < 2 else ""]
    return "\r\n".join([*lines, "--b--", ""]).encode()


MAILS = [mail(0), mail(1, parts=0), mail(2, body="curto"), mail(3, "<m0@x>"), mail(4, sender="outro@example.com"),
         mail(5, charset="x-nada"), mail(6, "<m5@x>"), mail(7, "<m5@x>", charset="x-nada"), mail(8, None), mail(9, None),
         mail(8, None), mail(10, parts=3), b"\xff\xfe nothing", mail(11, sender="outro@example.com", charset="x-nada"),
         mail(12, body="From inside\r\nFrom again, more than twenty letters")]
RESULTS = ["salvo", "salvo", "salvo", "duplicado", "ignorado", "falha", "salvo", "duplicado", "salvo", "salvo", "duplicado",
           "salvo", "ignorado", "ignorado", "salvo"]


def land(folder, first, last, start=0):
    os.makedirs(folder, exist_ok=True)
    for i in range(first, last):
        with open(f"{folder}/m{start + i:03d}.eml", "wb") as f:
            f.write(MAILS[i])
        os.utime(f"{folder}/m{start + i:03d}.eml", (1e9 + start + i, 1e9 + start + i))


def bundle(folder, name, mails):
    os.makedirs(folder, exist_ok=True)
    import re
    with open(f"{folder}/{name}.mbox", "wb") as f:
        for m in mails:
            f.write(b"From x\n" + re.sub(rb"^(>*From )", rb">\1", m, flags=re.M) + b"\n")


def outcomes_of(spark, base):
    rows = S.read_captured(spark, base, "resultados").collect()
    return {os.path.basename(r.path) + f"/{r.indice}": r.resultado for r in rows}


def content(spark, base):
    """The captured tables without batch numbers, in order."""
    out = {}
    for table in M.TABLES:
        df = S.read_captured(spark, base, table).drop("lote", "path")
        out[table] = sorted(map(repr, (tuple(r) for r in df.collect())))
    return out


def run(spark, folder, base, **kw):
    return S.run_capture(spark, folder, base, ME, as_of(), **kw)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """All messages captured in one batch of single files."""
    root = str(tmp_path_factory.mktemp("whole"))
    land(f"{root}/in", 0, len(MAILS))
    assert run(spark, f"{root}/in", f"{root}/out") == "finalizado"
    return root


def test_outcomes_follow_the_pass(spark, whole):
    got = outcomes_of(spark, f"{whole}/out")
    assert [got[f"m{i:03d}.eml/0"] for i in range(len(MAILS))] == RESULTS


def test_tables_of_a_pass(spark, whole):
    mails = S.read_captured(spark, f"{whole}/out", "emails").collect()
    assert len(mails) == RESULTS.count("salvo") == len({m.id_email for m in mails})
    assert sum(m.message_id.startswith("<hash-") for m in mails) == 2
    by_id = {m.message_id: m for m in mails}
    assert by_id["<m12@x>"].corpo_email == "From inside\r\nFrom again, more than twenty letters"
    assert str(by_id["<m0@x>"].recebido_em) == "1996-05-02 13:00:00"
    parts = S.read_captured(spark, f"{whole}/out", "anexos").where("id_email = '%s'" % by_id["<m10@x>"].id_email).collect()
    assert {(p.parte, p.nome_arquivo, p.tamanho, bytes(p.conteudo)) for p in parts} == {
        (1, "sem_nome", 7, b"dados 0"), (2, "a1.pdf", 7, b"dados 1")}  # the empty third part is not stored
    assert len({p.id_anexo for p in parts}) == 2
    quality = {(r.message_id, r.status) for r in S.read_captured(spark, f"{whole}/out", "falhas_qualidade").collect()}
    assert quality == {("<m1@x>", "sem_anexo"), ("<m2@x>", "fora_do_padrao")}


def test_split_input_and_bundles_equal_one_batch(spark, whole, scratch):
    land(f"{scratch}/split", 0, len(MAILS))
    run(spark, f"{scratch}/split", f"{scratch}/out", max_files=2)
    assert S.committed(spark, f"{scratch}/out").count() == (len(MAILS) + 1) // 2
    assert [c for c in content(spark, f"{scratch}/out").values()] == [c for c in content(spark, f"{whole}/out").values()]
    bundle(f"{scratch}/boxes", "a", MAILS)
    run(spark, f"{scratch}/boxes", f"{scratch}/out2")
    got = outcomes_of(spark, f"{scratch}/out2")
    assert [got[f"a.mbox/{i}"] for i in range(len(MAILS))] == RESULTS
    for table in ("emails", "anexos", "falhas_qualidade"):
        assert content(spark, f"{scratch}/out2")[table] == content(spark, f"{whole}/out")[table]


def test_batch_transform_equals_stream(spark, whole):
    m = M.landed_messages(parse_mailbox(read_landed_mail(spark, f"{whole}/in")), as_of()).cache()
    tables = M.capture_pass(m, M.pass_outcomes(m, m.select("message_id").limit(0), ME))
    streamed = content(spark, f"{whole}/out")
    for table, df in tables.items():
        assert sorted(map(repr, (tuple(r) for r in df.drop("path").collect()))) == streamed[table]


def test_replay_writes_nothing(spark, whole, scratch):
    land(f"{scratch}/in", 0, 5)
    files = read_landed_mail(spark, f"{scratch}/in")
    base = f"{scratch}/out"
    S.capture_batch(files, 0, base, ME, as_of())
    before = sorted(os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs)
    S.capture_batch(files, 0, base, ME, as_of())
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs) == before
    # A batch that was lost before its commit row is not seen, and its folders are overwritten.
    spark.createDataFrame([("x",)], "id_email string").write.parquet(f"{base}/falhas_qualidade/lote=7")
    assert S.read_captured(spark, base, "falhas_qualidade").where("lote = 7").count() == 0
    land(f"{scratch}/in2", 5, len(MAILS))
    S.capture_batch(read_landed_mail(spark, f"{scratch}/in2"), 7, base, ME, as_of())
    assert content(spark, base)["emails"] == content(spark, f"{whole}/out")["emails"]


def test_pause_leaves_files_for_later(spark, whole, scratch):
    land(f"{scratch}/in", 0, len(MAILS))
    asked = []

    def flags(close_at):
        def read():
            asked.append(1)
            value = "TRUE" if len(asked) > close_at else "false"
            return spark.createDataFrame([("pausar_pipeline", value)], "chave string, valor string")
        return read

    base = f"{scratch}/out"
    assert run(spark, f"{scratch}/in", base, flags=flags(3), max_files=2) == "pausado"
    assert S.committed(spark, base).count() == 3
    assert run(spark, f"{scratch}/in", base, flags=flags(0), max_files=2) == "pausado"
    assert S.committed(spark, base).count() == 3
    assert run(spark, f"{scratch}/in", base, flags=flags(10**6), max_files=2) == "finalizado"
    assert content(spark, base) == content(spark, f"{whole}/out")
    rows = S.progress_table(spark, base).orderBy("lote").collect()
    assert [r.n_arquivos for r in rows] == [2] * 7 + [1] and rows[-1].atual == len(MAILS) - 1
    assert sum(r.salvos for r in rows) == RESULTS.count("salvo") and sum(r.falhas for r in rows) == RESULTS.count("falha")
    assert all(r.duracao_ms > 0 for r in rows)


def test_errors_are_not_taken_for_a_pause(spark, scratch):
    from pyspark.errors import StreamingQueryException
    land(f"{scratch}/in", 0, 2)

    def broken():
        raise ValueError("no control table")

    with pytest.raises(StreamingQueryException):
        run(spark, f"{scratch}/in", f"{scratch}/out", flags=broken)


def test_bounded_stream_forgets_old_ids(spark, scratch):
    def at(n, mid, day):
        return mail(n, mid).replace(b"Thu, 02 May 1996", day)

    days = [[at(0, "<a@x>", b"Thu, 02 May 1996"), at(1, "<a@x>", b"Thu, 02 May 1996")],
            [at(2, "<b@x>", b"Sat, 01 Jun 1996"), at(3, "<a@x>", b"Thu, 02 May 1996")],
            [at(5, "<c@x>", b"Mon, 01 Jul 1996")],
            [at(4, "<a@x>", b"Tue, 02 Jul 1996"), at(6, "<c@x>", b"Tue, 02 Jul 1996")]]
    for i, mails in enumerate(days):
        bundle(f"{scratch}/in", f"d{i}", mails)
        os.utime(f"{scratch}/in/d{i}.mbox", (1e9 + i, 1e9 + i))
    q = (S.bounded_mail_stream(spark, f"{scratch}/in", ME, as_of(), "10 days", max_files=1)
         .writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/pos")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = [r.message_id for r in spark.read.parquet(f"{scratch}/out").collect()]
    # <a> comes back once the watermark passed its first arrival; <c> within the delay does not.
    assert sorted(got) == ["<a@x>", "<a@x>", "<b@x>", "<c@x>"]
    state = q.recentProgress[-1]["stateOperators"][0]
    assert state["numRowsTotal"] < 3 and sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress) >= 2


def test_empty_landing(spark, scratch):
    os.makedirs(f"{scratch}/in")
    assert run(spark, f"{scratch}/in", f"{scratch}/out") == "finalizado"
    assert S.read_captured(spark, f"{scratch}/out", "emails") is None


def test_split_mailbox():
    assert split_mailbox("a", b"Subject: x\n\nFrom y") == [b"Subject: x\n\nFrom y"]
    assert split_mailbox("a", b"From a\nx\n>From b\nFrom c\n>>From y\n") == [b"x\nFrom b\n", b">From y\n"]
