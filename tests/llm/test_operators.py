"""Each operator's contract query against brute force on whole small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailflow.llm import (embed_dedup, langid, lattice_lm, minhash, mixing, pii, quality, recompression,
                          sentencepiece_bpe, suffix_dedup)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OPS = [langid.op1, lattice_lm.op2, minhash.op3, sentencepiece_bpe.op4, suffix_dedup.op5, mixing.op7, pii.op8,
       recompression.op9, quality.op10]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_empty_table(op, empty):
    assert op(empty).count() == 0


def test_op1_predicts_held_out_languages(docs, rows):
    got = langid.op1(docs).collect()
    lang = {i: la for i, _, la, _ in rows}
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _, _ in rows}
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and held
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9


def test_op2_base_and_marginal(docs, rows):
    tokens = [(i, WORD.findall(lower(t)) + [None]) for i, t, _, _ in rows]
    train = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    want = {i: (len(ws), sum(train[w] > 0 for w in ws), sum(math.log10((train[w] + .5) / (n + .5 * (v + 1))) for w in ws))
            for i, ws in tokens}
    for r in lattice_lm.op2(docs).collect():
        a, b, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_op2_lattice_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", lattice_lm.FRONT]
    logp = np.log(np.array([.2, .1, .15, .05, .1, .2, .2]))
    lat = lattice_lm.Lattice(pieces)

    def ways(s):
        return 1.0 if not s else sum(math.exp(logp[i]) * ways(s[len(p):]) for i, p in enumerate(pieces) if s.startswith(p))

    words = [b"abab", b"baba", b"bbab", b"aaaa"]
    (at, x), = lattice_lm.by_length(words)
    assert np.exp(lat.forward(x, logp)) == pytest.approx([ways(lattice_lm.FRONT + words[i]) for i in at])
    total = np.zeros(lat.size)
    lat.expected(x, np.ones(4), logp, total)
    sizes = np.array([len(p) for p in pieces])
    assert (total[:-1] * sizes).sum() == pytest.approx(4 * 7)  # expected pieces cover all bytes


def test_op3_links_and_components(docs, rows):
    sets = {}
    for i, t, _, _ in rows:
        ws = WORD.findall(lower(t))
        sets[i] = set(zip(*(ws[k:] for k in range(5)))) if len(ws) >= 5 else {tuple(ws)} if ws else set()
    uf, ids = Union(), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                uf.join(a, b)
    got = minhash.op3(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), uf.find(r.doc_id), uf.find(r.doc_id) == r.doc_id)


def test_op3_index_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, minhash.K), np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.K, minhash.RADIUS, replace=False)
        row[at] = rng.integers(0, 1 << 16, minhash.RADIUS)
    both = [set(x) & set(y) for x, y in zip(minhash.chunk_keys(a).tolist(), minhash.chunk_keys(b).tolist())]
    assert all(both)


def test_op4_equals_the_library(docs, rows):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    want = {}
    for i, t, _, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i] = len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(lib.decode(ids).encode())
    got = sentencepiece_bpe.op4(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)


def test_op5_removes_repeated_byte_windows(docs, rows):
    raws = [(i, (t or "").encode()) for i, t, _, _ in rows]
    count = Counter(b[k:k + 200] for _, b in raws for k in range(len(b) - 199))
    want = {}
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        want[i] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))
    got = suffix_dedup.op5(docs).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got if (
        r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) != want[r.doc_id]] == []


def test_op5_marks_of_a_text_do_not_grow_with_its_copies(spark):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefgh "), 1500))
    other = "".join(["z" * 50, text[100:400], "z", *rng.choice(list("klmnop "), 249)])
    docs = spark.createDataFrame([(i, text) for i in range(3000)] + [(3000, other)], "doc_id long, text string").repartition(5)
    did = docs.selectExpr("text", "xxhash64(text) did")
    contexts = len(set(suffix_dedup.anchored([text.encode()]).contexts.tolist()))
    sizes = suffix_dedup.marks(did, suffix_dedup.anchored, False, suffix_dedup._last_digits).selectExpr("size(context) n").collect()
    assert max(r.n for r in sizes) <= contexts
    got = suffix_dedup.op5(docs).collect()
    assert len(got) == 3001
    assert all((r.n_bytes, r.n_removed, r.n_spans) == ((1500, 1500, 1) if r.doc_id < 3000 else (600, 300, 1)) for r in got)


def test_op6_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 16))
    v[10:30] = v[0] + rng.normal(size=(20, 16)) * 0.15
    v[30:40] = v[1]
    label = [i % 2 for i in range(60)]
    data = [(i, v[i].tolist(), label[i], 1) for i in range(60)]
    data += [(60, None, 0, 1), (61, [0.0] * 16, 0, 1), (62, [float("nan")] + [1.0] * 15, 0, 1), (63, v[1].tolist(), None, 1),
             (64, [None] + [1.0] * 15, 0, 1), (65, [], 0, 1), (66, (v[1] * 3).tolist(), 1, 1)]
    v, label = np.vstack([v, np.zeros((6, 16)), v[1:2] * 3]), label + [None] * 6 + [1]
    links, uf = Counter(), Union()
    for i in range(67):
        for j in range(67):
            if i != j and label[i] is not None and label[i] == label[j]:
                if v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.98:
                    links[i] += 1
                    uf.join(i, j)
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, m int")
    got = embed_dedup.op6(table).collect()
    assert len(got) == 67 and sum(links.values()) > 100
    assert all((r.n_links, r.component_id, r.kept) == (links[r.vec_id], uf.find(r.vec_id), uf.find(r.vec_id) == r.vec_id) for r in got)
    assert embed_dedup.op6(table.limit(0)).count() == 0


def test_op7_targets_and_budgets(docs, rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    total = Counter()
    for i, _, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rate = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * total[s]}
        if not over:
            break
        target.update((s, 2.0 * total[s]) for s in over)
        open_ -= over
    target.update((s, rate * weight[s]) for s in open_)
    got = mixing.op7(docs).collect()
    taken, most = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= most[s] for s in order)
    assert sorted(got) == sorted(mixing.op7(docs).collect())
    assert "Python" not in mixing.op7(docs)._jdf.queryExecution().toString()


def test_op8_base_rules(docs, rows):
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split("."))
                or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15)

    want = {i: [f"{k}:{m.start()}:{m.end()}" for k, p in rules for m in re.finditer(p, t or "") if good(k, m.group())]
            for i, t, _, _ in rows}
    got = pii.op8(docs).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 4
    for r in got:
        n = Counter(x.split(":")[0] for x in want[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == sha(",".join(want[r.doc_id]).encode()) and set(want[r.doc_id]) <= set(filter(None, r.spans.split(",")))


def test_op8_patterns_discover_unseen_identifiers(spark):
    text = [f"mail alpha{i} text. please dial hotline +1 (555) 010-{1000 + i} today" for i in range(30)]
    text += ["please dial hotline 555-010-4242 today", "the size is 555-010-4242 units", "id 1234567 of lot 7654321"]
    got = {r.doc_id: r.spans for r in pii.op8(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()}
    assert got[30] == "phone:20:32" and got[31] == "" and got[32] == ""
    assert all(got[i].count("phone:") == 1 for i in range(30))


@pytest.mark.parametrize("text", ["a@b.c_x@y.org @@ q@ .@z.de", "1.2.3.4.5.6.7.8.9 0001.2.3.0255 1.2.3.256", "9" * 3000, "a" * 3000 + "@"])
def test_op8_linear_rules_equal_the_plain_ones(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    got = pii.base_spans(text)
    assert [(s, e) for k, s, e in got if k == "email"] == email and [(s, e) for k, s, e in got if k == "ip"] == ip


def test_op9_removes_windows_of_smaller_documents(docs, rows):
    first: dict = {}
    for i, t, _, _ in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - 12):
            w = tuple(ws[k:k + 13])
            first[w] = min(i, first.get(w, i))
    want = {}
    for i, t, _, _ in rows:
        ws = WORD.findall(t or "")
        gone = [False] * len(ws)
        for k in range(len(ws) - 12):
            if first[tuple(ws[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        want[i] = len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g).encode())
    got = recompression.op9(docs).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 0
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def test_op9_symbols_recur_inside_equal_content():
    rng = np.random.default_rng(2)
    inner = rng.integers(0, 30, 60).astype(np.uint64)
    seen = []
    for _ in range(5):
        a, b = rng.integers(0, 30, 20).astype(np.uint64), rng.integers(0, 30, 20).astype(np.uint64)
        h = np.concatenate([a, inner, b]) * np.uint64(977) + np.uint64(1)
        s = recompression.symbols(h, np.array([0, len(h)]))[-1]
        keep = (s.lo >= 20) & (s.hi <= 80)
        seen.append(list(zip(s.name[keep].tolist(), (s.start[keep] - 20).tolist())))
    assert all(x == seen[0] for x in seen) and len(seen[0]) > 10


def test_op10_counts_and_verdicts(docs, rows):
    want = {}
    for i, t, _, _ in rows:
        ws = WORD.findall(t or "")
        grams = list(zip(ws, ws[1:], ws[2:]))
        n = Counter(grams)
        inside = {j for k, g in enumerate(grams) if n[g] > 1 for j in (k, k + 1, k + 2)}
        lines = Counter(x for x in (t or "").split("\n") if WORD.search(x))
        want[i] = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(c - 1 for c in lines.values()),
                   len(inside), len(ws) < 50 or 100 * len(inside) > 50 * len(ws))
    got = quality.op10(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    plain = [r for r in got if not r.base_failed and r.n_symbols == 0 and r.n_dup_lines == 0 and r.doc_id < 9000]
    noisy = [r for r in got if not r.base_failed and r.n_symbols > 0.1 * r.word_chars and r.doc_id < 9000]
    assert all(r.kept for r in plain) and noisy and not any(r.kept for r in noisy)


def test_op10_judges_small_sources_by_their_language(spark):
    rng = np.random.default_rng(8)

    def text(least, most, signs=0):
        ws = ["".join(rng.choice(list("abcdefghij"), rng.integers(least, most))) for _ in range(80)]
        return " ".join([*ws, *["####"] * signs])

    data = [(i, text(3, 9), "en", "web") for i in range(300)] + [(i, text(3, 9), "en", f"s{i % 9}") for i in range(300, 330)]
    data += [(i, text(20, 50), "th", f"s{i % 9}") for i in range(400, 436)]  # long mean words, a few a source
    data += [(500, text(3, 9, 40), "en", "web"), (501, text(3, 9, 40), "en", "s1"), (502, text(20, 50, 60), "th", "s1"),
             (503, text(20, 50), "en", "web"), (504, text(20, 50), "en", "s1")]
    got = quality.op10(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.doc_id for r in got if not r.base_failed and not r.kept) == [500, 501, 502, 503, 504]
    assert all(r.kept for r in got if r.doc_id < 500)


def test_mcd_ignores_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.5, 0.05, (400, 6))
    x[:60] = 5.0
    df = spark.createDataFrame([("g", 100, 10, *map(float, r)) for r in x],
                               "g string, n_words int, n_lines int, " + ", ".join(f"{s} double" for s in quality.STATS))
    c = quality.estimates(df).first()["c"]
    assert np.allclose(c, 0.5, atol=0.03)


def _numpy_mcd(x, n_words, n_lines, support, starts, rng):
    """Log determinant of the floored covariance after concentration steps, the best of many starts."""
    noise = np.array(quality.NOISE) / (4 * np.square(quality.FLOOR))
    shrink = np.sqrt(1 + noise / np.where(np.arange(6) == 2, n_lines, n_words))
    factor = support / quality._chi2_cdf(quality.chi2_quantile(support, 6), 8)
    h, best = int(np.ceil(support * len(x))), np.inf
    for _ in range(starts):
        c, v = (s := x[rng.choice(len(x), 8, replace=False)]).mean(0), np.cov(s.T, bias=True) * factor
        for _ in range(30):
            z = (x - c) / shrink
            d = np.einsum("ij,jk,ik->i", z, np.linalg.inv(v + np.diag(np.square(quality.FLOOR))), z)
            s = x[np.argsort(d, kind="stable")[:h]]
            c, v = s.mean(0), np.cov(s.T, bias=True) * factor
        best = min(best, np.linalg.slogdet(v + np.diag(np.square(quality.FLOOR)))[1])
    return best


def test_mcd_reaches_the_smallest_determinant_of_many_starts(spark):
    rng = np.random.default_rng(11)
    groups = {}
    for g, share in (("clean", 0.0), ("some", 0.1), ("much", 0.22)):
        mixer = rng.normal(0, 0.25, (6, 6))
        x = rng.normal(0, 1, (600, 6)) @ mixer + 1
        far = int(share * len(x))
        x[:far] = x[:far] * 0.3 + rng.normal(4, 0.5, 6)
        groups[g] = x
    data = [(g, 100, 10, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(data, "g string, n_words int, n_lines int, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = {r.g: r.det for r in quality.estimates(df).collect()}
    for g, x in groups.items():
        assert got[g] <= _numpy_mcd(x, 100, 10, 0.75, 40, rng) + 0.15, g


def test_mcd_of_tiny_groups(spark):
    data = [("one", 60, 1, *[0.5] * 6), *[("same", 60, 1, *[0.1] * 6)] * 5]
    df = spark.createDataFrame(data, "g string, n_words int, n_lines int, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = {r.g: (r.n, r.c) for r in quality.estimates(df).collect()}
    assert got["one"][0] == 1 and np.allclose(got["one"][1], 0.5) and np.allclose(got["same"][1], 0.1)
