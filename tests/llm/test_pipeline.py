"""The corpus pipeline against its operators' own results on a small folder."""

import re
from collections import Counter

import corpus_pipeline as P
from mailflow.llm import minhash, mixing, pii, quality


def test_stages_keep_what_they_should(spark, docs, rows, scratch):
    docs.write.parquet(f"{scratch}/documents.parquet")
    at, seen = spark.read.parquet(f"{scratch}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = at
        stage(spark, at, scratch).write.parquet(f"{scratch}/{name}")
        at = seen[name] = spark.read.parquet(f"{scratch}/{name}")
        if name != "encoding":
            assert at.columns == docs.columns
        if name == "quality":
            want = {r.doc_id for r in quality.op10(before).collect() if r.kept}
            assert {r.doc_id for r in at.collect()} == want
        elif name == "near_duplicates":
            want = sorted({r.doc_id for r in minhash.op3(before).collect() if r.kept})
            assert sorted(r.doc_id for r in at.collect()) == want
        elif name == "personal_data":
            text = {r.doc_id: r.text for r in before.collect()}
            spans = {r.doc_id: r.spans for r in pii.op8(before).collect()}
            for r in at.collect():
                assert r.text == pii.redact_text(text[r.doc_id], spans[r.doc_id]) and r.n_chars == len(r.text)
            assert sum(map(bool, spans.values())) > 0
        elif name == "mixing":
            want = Counter({r.doc_id: r.taken // r.size for r in mixing.op7(before).collect() if r.size and r.taken})
            assert Counter(r.doc_id for r in at.collect()) == want
    assert seen["encoding"].count() == seen["mixing"].count()
    assert all(len(r.ids) == r.n_tokens for r in seen["encoding"].collect())
    assert sorted(r.ids_sha256 for r in P.run(spark, scratch).collect()) == sorted(r.ids_sha256 for r in seen["encoding"].collect())


def test_null_ids_and_empty_tables(spark, docs, empty, scratch):
    lost = docs.limit(3).selectExpr("cast(null as long) doc_id", *[c for c in docs.columns if c != "doc_id"])
    assert P.without_near_duplicates(lost).count() == 3
    empty.write.parquet(f"{scratch}/documents.parquet")
    assert P.run(spark, scratch).count() == 0


def test_redaction_joins_overlapping_spans():
    assert P.pii.redact_text("ab 1234 cd", "card:3:5,phone:4:7") == "ab <card> cd"
    assert not re.search("[0-9]", P.pii.redact_text("+1 555 0100", "phone:0:11"))
