"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased; its subwords are the character n-grams (1 to 4) of its
letter runs with their borders. Each n-gram is hashed to a bucket that owns an
embedding; the text's embedding is the average over all its n-grams, and a
linear softmax gives the languages. The model is trained by stochastic
gradient descent in numpy on a bounded, hash-chosen sample of the distinct
labelled texts (``sample_docs`` in all, shared over the languages); a part of the sample
that takes no part in the training sets the temperature and the rejection
threshold.

Defined results: null or letterless text -> ``und`` with score 0, not
accepted; no labelled training row -> every text ``und``; an empty table ->
no rows; repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix

BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
BLOCK = 1 << 20
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; whatever is no letter becomes a border (0)."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[c], c, 0).astype(np.uint32)


def ngram_buckets(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the start of each n-gram in ``c`` and its bucket.

    Borders may be the first or last sign of an n-gram, never an inner one.
    """
    c64, letter = c.astype(np.uint64), c > 0
    for n in ORDERS:
        if len(c) < n:
            return
        m = len(c) - n + 1
        h, ok = np.full(m, n, np.uint64), letter[:m] if n == 1 else letter[:m] | letter[n - 1:]
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + c64[i:i + m]
            if 0 < i < n - 1:
                ok = ok & letter[i:i + m]
        at = np.flatnonzero(ok)
        yield at, (mix(h[at]) >> np.uint64(49)).astype(np.int64)


def _blocks(c: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of bounded size, cut at borders where there is one."""
    s = 0
    while len(c) - s > BLOCK:
        gaps = np.flatnonzero(c[s:s + BLOCK] == 0)
        e = s + (int(gaps[-1]) if len(gaps) and gaps[-1] > 0 else BLOCK)
        yield c[s:e + 1]
        s = e
    yield c[s:]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the whole text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for c in _blocks(code_points(text or "")):
        for _, b in ngram_buckets(np.pad(c, 1)):
            total += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """Trained weights: ``table`` (bucket x class logits), temperature, threshold."""

    def __init__(self, classes, table, bias, temperature, threshold):
        self.classes, self.table, self.bias = classes, table, bias
        self.temperature, self.threshold = temperature, threshold

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        sums, counts = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        group: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal group, owner, size
            if group:
                # Each text has a border of its own on either side.
                starts = np.cumsum([0, *(len(g) + 2 for g in group[:-1])])
                c = np.zeros(size, np.uint32)
                for s, g in zip(starts, group):
                    c[s + 1:s + 1 + len(g)] = g
                for at, b in ngram_buckets(c):
                    cuts = np.searchsorted(at, [*starts, size])
                    sizes = np.diff(cuts)
                    has = np.flatnonzero(sizes)
                    if len(has):
                        who = np.asarray(owner)[has]
                        np.add.at(sums, who, np.add.reduceat(self.table[b], cuts[:-1][has], axis=0, dtype=np.float64))
                        np.add.at(counts, who, sizes[has])
            group, owner, size = [], [], 0

        for i, t in enumerate(texts):
            for c in _blocks(code_points(t or "")):
                if size + len(c) > BLOCK:
                    flush()
                group.append(c)
                owner.append(i)
                size += len(c) + 2
        flush()
        for s, n in zip(sums, counts):
            if not n or not self.classes:
                out.append(("und", 0.0, False))
                continue
            z = (s / n + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p.argmax())
            out.append((self.classes[k], float(p[k]), bool(p[k] >= self.threshold)))
        return out


def fit(sample: pd.DataFrame, epochs: int = 6, rate: float = 2.0, seed: int = 7,
        target_error: float = 0.01) -> Model:
    """SGD on rows ``lang, buckets, counts, calibrate`` (features of whole texts)."""
    rows = [(r.lang, np.asarray(r.buckets), np.asarray(r.counts, float), r.calibrate)
            for r in sample.itertuples() if len(r.buckets)]
    classes = sorted({r[0] for r in rows})
    k, rng = len(classes), np.random.default_rng(seed)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    emb, lin, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, k)), np.zeros(k)
    rows = [(classes.index(y), b, c / c.sum(), cal) for y, b, c, cal in rows]
    train = [r for r in rows if not r[3]] or rows
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            y, b, w, _cal = train[i]
            lr = rate * (1 - done / steps)
            e = w @ emb[b]
            z = e @ lin + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = lin @ g
            lin -= lr * np.outer(e, g)
            bias -= 0.05 * lr * g
            emb[b] -= lr * 20 * w[:, None] * back
            done += 1
    table = (emb @ lin).astype(np.float32)
    # Calibration on rows that the training did not see.
    held = [r for r in rows if r[3]] or rows
    z = np.array([w @ table[b] + bias for _, b, w, _c in held])
    y = np.array([r[0] for r in held])

    def probs(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    temps = np.geomspace(0.05, 20, 60)
    loss = [-np.log(probs(t)[np.arange(len(y)), y] + 1e-12).mean() for t in temps]
    t = float(temps[int(np.argmin(loss))])
    p = probs(t)
    conf, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-conf, kind="stable")
    error = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(error <= target_error)
    threshold = float(conf[order][fine[-1]]) if len(fine) else 1.0
    return Model(classes, table, bias, t, threshold)


def heaviest(found: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent buckets of a text (of equal ones the first), in order."""
    at, n = found
    pick = np.sort(np.argsort(-n, kind="stable")[:most])
    return at[pick], n[pick]


def train(docs: DataFrame, sample_docs: int = 2000, sample_buckets: int = 4096, seed: int = 7) -> Model:
    """Fit on about ``sample_docs`` distinct labelled texts of ``docs(text, lang)``.

    Per language the distinct texts with the smallest hash fractions are taken,
    so that the languages share the sample and copies of a text, however many,
    are one of it. What reaches the driver is one row per language and the
    counts of the ``sample_buckets`` most frequent buckets of each sampled text:
    2000 x 4096 x 12 bytes, 98 MB, at most about.
    """
    rows = docs.where("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64("text", F.lit(seed)).alias("hash"))
    rows = rows.withColumn("at", F.pmod("hash", F.lit(1 << 30)) / (1 << 30))
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}
    if not langs:
        return fit(pd.DataFrame(columns=["lang", "buckets", "counts", "calibrate"]))
    each = sample_docs / len(langs)
    share = F.create_map(*[F.lit(x) for k, n in langs.items() for x in (k, min(1.0, each / max(n, 1)))])
    sample = (rows.where(F.col("at") < share[F.col("lang")])
              .groupBy("lang", "hash").agg(F.min("at").alias("at"), F.first("text").alias("text")))  # equal texts

    def featurize(batches):
        for b in batches:
            found = [heaviest(features(t), sample_buckets) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "at": b["at"], "buckets": [x for x, _ in found],
                                "counts": [n for _, n in found]})

    got = sample.select("lang", "at", "text").mapInPandas(
        featurize, "lang string, at double, buckets array<int>, counts array<long>").toPandas()
    got = got.sort_values(["at", "lang"], kind="stable").reset_index(drop=True)
    got["calibrate"] = got.index % 5 == 4
    return fit(got, seed=seed)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with ``lang_pred, score, accepted`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            found = shared.value.predict([None if pd.isna(t) else t for t in b["text"]])
            out = b[keep].copy()
            out["lang_pred"], out["score"], out["accepted"] = ([f[i] for f in found] for i in range(3))
            yield out

    return (docs.select(*keep, "text")
            .mapInPandas(run, schema + ", lang_pred string, score double, accepted boolean"))


def op1(documents: DataFrame) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 4 is not 2, predict every row."""
    docs = documents.select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    model = train(docs.where("not held_out"))
    return identify(docs, model, ["doc_id", "held_out"])
