"""Token files, ranked search and vector codes against the library and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers

import public_tokenizers
from mailflow.llm import mixcoder, ranked_search, token_files, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


# -- op11 ------------------------------------------------------------------------
@pytest.mark.parametrize("sizes", [(1,), (1, 300, 8192, 8192, 17), (100,) * 40])
def test_coder_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    blocks = [np.minimum(rng.zipf(1.3, n), 50256) for n in sizes] + [np.zeros(5000, int), np.arange(8192)]
    data = b"".join(mixcoder.encode(blocks))
    got, at = mixcoder.read_blocks(memoryview(data), 0, len(blocks))
    assert at == len(data)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, blocks))


def test_coder_uses_what_repeats():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 4000, 8192)
    again = np.tile(noise[:512], 16)
    plain, repeated = (len(x) for x in mixcoder.encode([noise, again]))
    assert repeated < plain / 5


@pytest.mark.parametrize("at", [3, 40, -3])
def test_damage_is_noticed(at):
    data = bytearray(mixcoder.encode([np.arange(1000) % 37])[0])
    data[at] ^= 1
    with pytest.raises((mixcoder.DamagedBlock, zlib.error, MemoryError)):
        mixcoder.read_blocks(memoryview(bytes(data)), 0, 1)


def test_segments_give_the_librarys_ids(rows):
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "it's 'tis foo's", "a\tb c", "\n", "\na", "a\n", "a \nb", "a\n b",
           "<|endoftext|> x <|endoftext|>", "a,b .c ,d", "\x00 a\x1c b", "日本 語 ²³ x² ½", "don't   stop\r\nnow",
           "foo'll've x'", "\x85a \x85 b", "é!è", "1,2 3.4 a1!b", "naïve—dash “q”", "x　 y"]
    texts = odd + [t or "" for _, t, _, _ in rows]
    encode = token_files.Encoder(PATH)
    assert encode(texts) == encode.whole(texts) == encode(texts)
    encode.SEGMENTS = 0
    assert encode(texts) == encode.whole(texts)


def test_op11_reads_back_every_document(docs, rows, empty):
    library = tokenizers.Tokenizer.from_file(PATH)
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t, _, _ in rows]
    ids.sort(key=lambda x: (x[0], zlib.crc32(x[1].astype("<u2").tobytes())))
    start, want = 0, []
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    got = sorted(tuple(r) for r in token_files.op11(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)
    assert token_files.op11(empty).count() == 0


def test_op11_files_close_at_documents_and_null_ids_come_first(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    data = [(None, "null id"), (2, "b " * 90), (1, None), (3, ""), (2, "other")]
    got = {(r.doc_id, r.n_tokens): r.start for r in token_files.op11(spark.createDataFrame(data, "doc_id int, text string")).collect()}
    assert len(got) == 5 and got[(None, 3)] == 0 and got[(1, 1)] == 3
    assert sorted(got.values()) == sorted({*got.values()})


# -- op12 ------------------------------------------------------------------------
def brute_search(docs, items, k=20):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    held = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, size = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        need = Counter(TERM.findall(low(text)))
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // size
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in need.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if u else i, -s) for r, (s, u, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(df):
    return sorted(map(repr, (tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())))


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [t for _, t, _, _ in rows if t and len(t) > 200]
    return [(i, texts[7 * i][50:250]) for i in range(12)] + [(50, "w7 w7 W7 ha x"), (51, None), (52, ""), (53, "?!"), (54, "nowhereatall")]


def test_op12_equals_brute_force(spark, docs, rows, items, monkeypatch):
    frame = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, term int")
    want = sorted(map(repr, brute_search([(i, t) for i, t, _, _ in rows], items)))
    assert found(ranked_search.op12(docs, frame)) == want
    # Many shards, blocks of two documents and three blocks of queries find the same.
    monkeypatch.setattr(ranked_search, "SHARD_ROWS", 9)
    monkeypatch.setattr(ranked_search, "BLOCK", 2)
    monkeypatch.setattr(ranked_search, "QUERY_ROWS", 5)
    assert found(ranked_search.op12(docs, frame)) == want


def test_op12_ties_and_empty_tables(spark, empty):
    data = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here"), (99, None), (100, "--"), (101, "other")]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "words"), (1, "words"), (1, "other")], "item_id long, text string")
    assert found(ranked_search.op12(table, items)) == sorted(map(repr, brute_search(data, [(1, "words"), (1, "other")])))
    assert ranked_search.op12(empty, items).count() == 0
    assert ranked_search.op12(table, items.limit(0)).count() == 0


def test_blocks_without_a_candidate_stay_packed():
    texts = [f"common w{i}" + (" rare" if i == 500 else "") for i in range(1000)]
    batch = ranked_search._shard_rows("0", list(range(1000)), texts, 1000, 2001).to_pylist()
    shard = ranked_search._Shard(batch[0]["postings"], 1000, 1000, 2001)
    for row in batch[1:]:
        shard.lists[row["term"]] = ranked_search._List(*(row[c] for c in ("df", "best", "lasts", "maxima", "ends", "postings")))
    assert [d for _, _, d in shard.search([("common", 1), ("rare", 7000)], 1, 1)] == [500]
    assert len(shard.lists["common"].lasts) == 16 and len(shard.lists["common"].opened) <= 1


# -- op13 ------------------------------------------------------------------------
def brute_codes(rows):
    kept = [(i, v, la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = 8 * max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 8))
    each = width // 8
    cells = [[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0], kept[r][1]))[:16]
    books = [[cells[r][p * each:(p + 1) * each] for r in first] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(6):
        new = []
        for p, book in enumerate(books):
            got = [[] for _ in book]
            for c in cells:
                part = c[p * each:(p + 1) * each]
                got[near(part, book)[1]].append(part)
            new.append([[sum(col) // len(g) for col in zip(*g)] if g else e for g, e in zip(got, book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    picks = [[near(c[p * each:(p + 1) * each], books[p]) for p in range(8)] for c in cells]
    errors = [min(sum(d for d, _ in x), (1 << 63) - 1) for x in picks]
    label = Counter()
    for (_, _, la), e in zip(kept, errors):
        label[la] += e
    return sorted(((i, "".join(f"{j:02x}" for _, j in x), e, min(label[la], (1 << 63) - 1), digest)
                   for (i, _, la), x, e in zip(kept, picks, errors)), key=repr)


def codes(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(4)
    got = vector_codes.op13(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, .2, (12, width))
    return [(i, [float(np.float32(x)) for x in base[i % 12] + rng.normal(0, .05, width)], i % 3 if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("width", [64, 24, 8])
def test_op13_equals_brute_force(spark, width):
    rows = vectors(150, width, width)
    rows += [(500, None, 1), (501, [float("nan")] * width, 1), (502, [None] + [0.5] * (width - 1), 2), (503, [float("inf")] * width, 0),
             (504, rows[3][1], 1), (505, [0.0] * width, None), (506, [0.25] * (width - 3), 1), (507, [], 1), (3, rows[3][1], 0)]
    assert codes(spark, rows) == brute_codes(rows)


def test_op13_few_large_and_no_vectors(spark):
    few = [(i, [float(i)] * 16, 1) for i in range(5)]
    assert codes(spark, few) == brute_codes(few)
    large = [(i, [1e6 * (i - 20) + j for j in range(16)], i % 2) for i in range(40)] + [(90, [1e300] * 16, 5), (91, [-3e9] * 16, 5)]
    assert codes(spark, large[:40], "double") == brute_codes(large[:40])
    assert len(codes(spark, [(0, [3e9] * 8, 1), (1, [-3e9] * 8, 1)], "double")) == 2
    assert codes(spark, []) == []


def test_nearest_takes_the_lower_index_on_ties():
    rng = np.random.default_rng(3)
    parts, entries = rng.integers(-3, 4, (400, 5)), rng.integers(-3, 4, (16, 5))
    entries[9] = entries[2]
    far = ((parts[:, None] - entries) ** 2).sum(axis=2)
    chosen, error = vector_codes.nearest(parts, entries)
    assert (chosen == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
