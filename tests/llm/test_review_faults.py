"""Cases that reviews of the operators found: unlike rows under one id, vector lengths, twin words, chains of patterns."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from mailflow.llm import embed_dedup, langid, lattice_lm, minhash, mixing, pii, recompression

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
B = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def test_texts_of_one_doc_id_join_their_groups(spark):
    rows = [(5, A), (5, B), (2, A), (3, B), (7, "quite other words are here for all"), (9, None), (9, A.upper())]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.op3(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2, True), (3, 2, False), (5, 2, False), (5, 2, False), (7, 7, True), (9, 2, False), (9, 9, True)]


def test_pipeline_keeps_unlike_texts_of_one_doc_id(spark):
    rows = [(5, A, "x"), (5, B, "x"), (5, B, "x"), (6, A, "x"), (8, A + " phi", "y"), (None, A, "z"), (4, "", "z"), (4, "", "z")]
    got = P.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == [(0, A), (4, ""), (5, A), (5, B)]


def test_every_length_of_vectors_is_compared(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0, 3.0], 1), (4, [2.0, 4.0, 6.0], 1), (5, [1.0, -2.0, 3.0], 1),
            (6, [2.0, 4.0], 1), (7, [2.0, 4.0], 2), (8, [1.0], 1), (9, [5.0], 1), (10, [-5.0], 1)]
    got = embed_dedup.op6(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        1: (2, 1), 2: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (2, 1), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (0, 10)}


def twins(n):
    """A Thue-Morse word and its letter-swapped twin, on which polynomials modulo 2**64 collide."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_twin_words_are_different_words(spark):
    for n in (1024, 4096):
        one, two = twins(n)
        words = [f"w{i}" for i in range(13)]
        first, second = " ".join([*words[:6], one, *words[7:]]), " ".join([*words[:6], two, *words[7:]])
        df = spark.createDataFrame([(1, first), (2, second), (3, first)], "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.op9(df).collect()}
        assert got[2] == (13, 0, hashlib.sha256(second.encode()).hexdigest())
        assert got[1][1] == 0 and got[3][1] == 13


def test_pii_finds_lists_and_two_hops(spark):
    phones = [f"+1 555 010 {i:04d}" for i in range(12)]
    bare = [f"555-010-{4000 + i}" for i in range(12)]
    rows = [f"please dial hotline {p} now" for p in phones] + [f"please dial hotline {b} now" for b in bare]
    rows += [f"or use faxline box {b} today" for b in bare]  # known only by what the hotline pattern found
    rows += ["or use faxline box 777-888-9999 today", "please dial hotline 444-333-2221 444-333-2222 now", "item 123-456-7890 sold"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.op8(df).collect()}
    n = len(phones)
    assert all("phone" in got[i] for i in range(3 * n + 1))
    text, spans = rows[3 * n + 1], got[3 * n + 1].split(",")
    assert [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in spans] == ["444-333-2221", "444-333-2222"]
    assert got[3 * n + 2] == ""


def test_op1_sample_of_copies_and_null_ids(spark):
    rows = [(None, "ein hund und eine katze", "de")] * 3000 + [(None, f"the dog and the cat {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample_docs=100)
    assert model.classes == ["de", "en"]
    found = [p[0] for p in model.predict(["ein hund und eine katze", "the dog and the cat 7"])]
    assert found == ["de", "en"]


def test_op1_sampled_buckets_are_bounded():
    at, n = langid.heaviest((np.array([1, 5, 9, 12]), np.array([3, 7, 3, 7])), 3)
    assert at.tolist() == [1, 5, 12] and n.tolist() == [3, 7, 7]


def test_op2_long_words_agree_with_the_short_way(monkeypatch):
    pieces, logp = lattice_lm.vocabulary()
    lattice = lattice_lm.Lattice(pieces)
    rng = np.random.default_rng(2)
    word = ("".join(rng.choice(["the", "ing", "q", "é", "zz", "ation", "7"], 120))).encode()
    x = np.frombuffer(word, np.uint8)[None, :]
    short, long = np.zeros(lattice.size), np.zeros(lattice.size)
    monkeypatch.setattr(lattice_lm, "LONG", 10**9)
    one = lattice.forward(x, logp)
    lattice.expected(x, np.array([3.0]), logp, short)
    monkeypatch.setattr(lattice_lm, "LONG", 8)
    monkeypatch.setattr(lattice_lm, "LONG_BLOCK", 50)
    two = lattice.forward(x, logp)
    lattice.expected(x, np.array([3.0]), logp, long)
    assert np.allclose(one, two) and np.allclose(short, long)


def test_op2_marginal_is_the_sum_over_all_segmentations():
    pieces, logp = lattice_lm.vocabulary()
    lattice, prob = lattice_lm.Lattice(pieces), dict(zip(pieces, np.exp(logp)))

    def every(w):
        return 1.0 if not w else sum(prob[w[:k]] * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in prob)

    for w in (b"the", b"zqx", "né".encode(), b"banana"):
        x = np.frombuffer(lattice_lm.FRONT + w, np.uint8)[None, :]
        assert np.isclose(lattice.forward(x, logp)[0], np.log(every(lattice_lm.FRONT + w)))


def test_op7_ties_are_settled_by_content(spark):
    rows = [(i % 3, f"{'ab' * (1 + i % 4)} x{i}", "s") for i in range(60)]
    one = spark.createDataFrame(rows, "doc_id long, text string, source string")
    two = spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5)

    def taken(d):
        sized = d.withColumns({"size": F.regexp_count("text", F.lit(r"\S+")).cast("long"), "quality": F.lit(0.5)})
        return sorted((r.text, r.taken) for r in mixing.mix(sized, share=0.7).collect())

    assert taken(one) == taken(two)
