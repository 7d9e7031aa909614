"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives counts (words, symbols, repeated lines, repeated three-word
windows, capitals, signs that are no letters) that become a vector of
transformed statistics: log mean word length and square roots of shares. Per
language and source a minimum-covariance-determinant estimate is found by
concentration steps over all its documents: keep the ``support`` share of documents
that are nearest, take their mean and covariance, repeat. Every group has three
starts (medians and quartiles; the covariance of signs about the medians; a few
documents chosen by hash), each takes ``race`` steps, and the one whose covariance
has the smallest determinant goes on until no group's determinant falls by more
than ``CLOSE``. A document whose squared Mahalanobis distance exceeds
a chi-square quantile is rejected. Each step is a Spark aggregation of fixed-size
sums, with partial sums before the shuffle, so a hot source is no single task's work.

Every group has its own estimate, whatever its size, and what a small one
lacks comes smoothly from its language: an estimate is that of its n nearest
documents and ``min_group`` more as its language has them; the language's is
that of its own and ``pool`` more as all documents have them. ``pool`` is
small, since sources of one language are written alike and languages are not.

The variance of every statistic is floored at ``FLOOR`` squared plus what a
share of n words (or lines) scatters by itself (``NOISE / n``), so a text with one
odd sign, or a short one, is no outlier for that.

Defined results: null or empty text -> zero counts, ``base_failed``, not kept;
null language or source form groups of their own; repeated rows are judged
alike; an empty table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut, sized_broadcast, stored

SYMBOLS = b"#*$%&|<>"  # the characters counted as symbols
STATS = ("x0", "x1", "x2", "x3", "x4", "x5")
FLOOR = (0.08, 0.06, 0.10, 0.15, 0.10, 0.10)
NOISE = (1.0, 1.0, 1.0, 3.0, 1.0, 1.0)
D = len(STATS)
FEW = 2 * (D + 1)  # documents of the start chosen by hash
CLOSE = 0.01  # of the determinant's logarithm
BINS = 32  # of distances, an octave


def repeat_words(ws: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    grams = list(zip(ws, ws[1:], ws[2:]))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = np.zeros(len(ws) + 1, np.int64)
    at = np.fromiter((i for i, g in enumerate(grams) if g in often), np.int64)
    for k in range(3):
        hit[at + k] = 1
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines, capitals, others)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    inside = b"".join(ws)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    capitals = len(inside) - len(inside.translate(None, _UPPER))
    others = len(inside) - len(inside.translate(None, _OTHER))
    return len(ws), chars, symbols, dup, repeat_words(ws), len(lines), capitals, others


_UPPER = bytes(range(65, 91))
_OTHER = bytes(b for b in range(33, 127) if not chr(b).isalpha())


def _share(a: str, b: str) -> Column:
    return F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each whole text and its vector ``x0..x5``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_lines", "n_capitals", "n_others"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + [f"{n} long" for n in names])

    def run(batches):
        for b in batches:
            rows = [measure(None if pd.isna(t) else t) for t in b["text"]]
            out = b[keep].copy()
            for i, n in enumerate(names):
                out[n] = [r[i] for r in rows]
            yield out

    text = [] if "text" in keep else ["text"]
    words = F.greatest("n_words", F.lit(1))
    return (docs.select(*keep, *text).mapInPandas(run, schema)
            .withColumns({"x0": F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))),
                          "x1": _share("n_symbols", "word_chars"), "x2": _share("n_dup_lines", "n_lines"),
                          "x3": _share("n_repeat_words", "n_words"), "x4": _share("n_capitals", "word_chars"),
                          "x5": _share("n_others", "word_chars")}))


def _chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 400):
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _inverse(factor: float):
    """Rows of sums -> count, centre, covariance, inverse of the floored covariance and the log of its determinant."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                n, s = max(float(r.n), 1.0), np.array(r.s, float)
                q = np.zeros((D, D))
                q[np.triu_indices(D)] = np.array(r.q, float)
                q = q + np.triu(q, 1).T
                c = s / n
                cov = (q / n - np.outer(c, c)) * factor
                w, v = np.linalg.eigh(cov)
                cov = v @ np.diag(np.maximum(w, 0)) @ v.T
                out.append((r.g, r.start, n, c.tolist(), cov.ravel().tolist(), _precision(cov),
                            float(np.linalg.slogdet(cov + np.diag(np.square(FLOOR)))[1])))
            yield pd.DataFrame(out, columns=["g", "start", "n", "c", "v", "p", "det"])
    return run


ESTIMATE = "g string, start int, n double, c array<double>, v array<double>, p array<double>, det double"


def _precision(cov: np.ndarray) -> list[float]:
    return np.linalg.inv(cov + np.diag(np.square(FLOOR))).ravel().tolist()


def pooled(n: float, c: np.ndarray, v: np.ndarray, k: float, c0: np.ndarray, v0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of n documents and k more as a wider estimate has them."""
    a, b, d = n / (n + k), k / (n + k), c - c0
    return a * c + b * c0, a * v + b * v0 + a * b * np.outer(d, d)


def _lent(min_group: int, pool: int, everyone: Row | None):
    """Rows with the estimates of a group and its language (1), and the one of all documents -> the group's centre and inverse."""
    c0, v0 = (np.array(everyone.c, float), np.array(everyone.v, float).reshape(D, D)) if everyone else (None, None)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                c, c1 = (np.array(x, float) for x in (r.c, r.c1))
                v, v1 = (np.array(x, float).reshape(D, D) for x in (r.v, r.v1))
                c, v = pooled(r.n, c, v, min_group, *pooled(r.n1, c1, v1, pool, c0, v0))
                out.append((r.grp, c.tolist(), _precision(v)))
            yield pd.DataFrame(out, columns=["grp", "c", "p"])
    return run


def _distance() -> Column:
    """Squared Mahalanobis distance, shrunk for what short texts scatter by themselves."""
    z = [(F.col(x) - F.col("c")[i]) / F.sqrt(1 + F.lit(NOISE[i] / (4 * FLOOR[i] ** 2))
                                             / F.greatest("n_lines" if x == "x2" else "n_words", F.lit(1)))
         for i, x in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            total = total + z[i] * z[j] * F.col("p")[i * D + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _sums(rows: DataFrame) -> DataFrame:
    """Per group g and start: count, sums and products; fixed size, so partial sums are small."""
    pairs = [F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i in range(D) for j in range(i, D)]
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in STATS]).alias("s"),
                                          F.array(*pairs).alias("q"))


def _start(rows: DataFrame) -> DataFrame:
    """Median and quartile scale of each statistic, from counts in steps of 1/256."""
    bins = (rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) * 256) for x in STATS])).alias("k", "bin"))
            .groupBy("g", "k", "bin").agg(F.count("*").alias("n")))
    w = Window.partitionBy("g", "k").orderBy("bin")
    run = bins.select("g", "k", "bin", F.sum("n").over(w).alias("upto"),
                      F.sum("n").over(Window.partitionBy("g", "k")).alias("all"))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), (F.col("bin") + 0.5) / 256))
    q = run.groupBy("g", "k").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("iqr"))
    floor = F.element_at(F.array(*[F.lit(x) for x in FLOOR]), F.col("k") + 1)
    q = q.withColumn("v", 1 / (F.pow(F.col("iqr") / 1.349, 2) + F.pow(floor, 2)))
    one = lambda col, k: F.max(F.when(F.col("k") == k, F.col(col)))
    zero = F.lit(0.0)
    return q.groupBy("g").agg(
        F.array(*[one("mid", i) for i in range(D)]).alias("c"),
        F.array(*[one("v", i) if i == j else zero for i in range(D) for j in range(D)]).alias("p"))


def _signs(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """Covariance of the signs about the medians: each document's direction counts, not how far it is."""
    z = [(F.col(x) - F.col("c")[i]) * F.sqrt(F.col("p")[i * D + i]) for i, x in enumerate(STATS)]
    far = F.greatest(F.sqrt(sum((x * x for x in z), F.lit(0.0))), F.lit(1e-6))
    signs = (rows.join(sized_broadcast(middle.select("g", "c", "p"), 20_000), "g")
             .withColumn("far", far).select("g", F.lit(1).alias("start"), *[(x / F.col("far")).alias(n) for x, n in zip(z, STATS)]))

    def back(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                q = np.zeros((D, D))
                q[np.triu_indices(D)] = np.array(r.q, float) * D / max(float(r.n), 1.0)  # of unit scale where nothing correlates
                scale = 1 / np.sqrt(np.diag(np.array(r.p, float).reshape(D, D)))
                cov = (q + np.triu(q, 1).T) * np.outer(scale, scale)
                out.append((r.g, r.start, list(r.c), _precision(cov)))
            yield pd.DataFrame(out, columns=["g", "start", "c", "p"])

    return (_sums(signs).join(middle.select("g", "c", "p"), "g")
            .mapInPandas(back, "g string, start int, c array<double>, p array<double>"))


def _few(rows: DataFrame, factor: float) -> DataFrame:
    """Centre and covariance of about ``FEW`` documents of each group, chosen by a hash of their statistics."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"))
    u = F.pmod(F.xxhash64(*STATS), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(sized_broadcast(cut(sizes), 20_000), "g").where(u * F.col("size") < FEW)
    return _sums(chosen.withColumn("start", F.lit(2))).mapInPandas(_inverse(factor), ESTIMATE).select("g", "start", "c", "p")


def _step(rows: DataFrame, now: DataFrame, support: float, factor: float) -> DataFrame:
    """One concentration step of every group and start: the estimate of the nearest ``support`` share."""
    d = (rows.join(sized_broadcast(now.select("g", "start", "c", "p"), 20_000), "g")  # a row for each start
         .withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * BINS)).select("g", "start", "bin", *STATS))
    per = d.groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "start").orderBy("bin")
    edge = (per.select("g", "start", "bin", F.sum("n").over(w).alias("upto"),
                       F.sum("n").over(Window.partitionBy("g", "start")).alias("all"))
            .where(F.col("upto") >= F.lit(support) * F.col("all"))
            .groupBy("g", "start").agg(F.min("bin").alias("edge")))
    near = d.join(sized_broadcast(cut(edge), 20_000), ["g", "start"]).where("bin <= edge")  # a hot group stays in its tasks
    return cut(_sums(near).mapInPandas(_inverse(factor), ESTIMATE))


def estimates(rows: DataFrame, support: float = 0.75, race: int = 2, steps: int = 6) -> DataFrame:
    """Of each group ``g`` by concentration steps: count ``n`` of the nearest documents, their
    centre ``c``, covariance ``v``, the inverse ``p`` of the floored covariance and its ``det`` (log).

    ``steps`` bounds all steps, the ``race`` among them.
    """
    factor = support / _chi2_cdf(chi2_quantile(support, D), D + 2)
    middle = cut(_start(rows))
    now = cut(middle.select("g", F.lit(0).alias("start"), "c", "p")
              .unionByName(_signs(rows, middle)).unionByName(_few(rows, factor)))
    for _ in range(race):
        now = _step(rows, now, support, factor)
    # The smallest determinant stays (of equal ones the first start).
    now = cut(now.groupBy("g").agg(F.min_by(F.struct("start", "n", "c", "v", "p", "det"), F.struct("det", "start")).alias("best"))
              .select("g", "best.*"))
    for _ in range(race, steps):
        then, now = now, _step(rows, now, support, factor)
        fall = (now.join(then.select("g", F.col("det").alias("was")), "g")
                .agg(F.max(F.abs(F.col("was") - F.col("det"))).alias("most")).first()["most"])
        if fall is None or fall <= CLOSE:
            break
    return now


def judge(docs: DataFrame, keep: list[str], confidence: float = 0.99, min_group: int = 200, pool: int = 20) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` of each document.

    A squared distance over the chi-square quantile at ``confidence`` rejects.
    ``docs`` needs ``text, lang, source``. ``keep`` names the columns to carry.
    """
    carried = list(dict.fromkeys([*keep, "lang", "source"]))
    lang = F.coalesce("lang", F.lit("\x00"))
    m = stored(measured(docs, carried).withColumns({
        "grp": F.concat_ws("\x1f", F.lit("2"), lang, F.coalesce("source", F.lit("\x00"))),
        "wide": F.concat_ws("\x1f", F.lit("1"), lang),
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")}), "quality")
    fit = m.where("not base_failed")
    levels = F.explode(F.array("grp", "wide", F.lit("0")))
    est = estimates(fit.select(levels.alias("g"), "n_words", "n_lines", *STATS))
    level = lambda key, to: est.select(F.col("g").alias(key), *[F.col(x).alias(x + to) for x in ("n", "c", "v")])
    everyone = est.where("g = '0'").select("c", "v").first()  # one row of fixed size
    pick = (fit.select("grp", "wide").distinct()
            .join(level("grp", ""), "grp").join(level("wide", "1"), "wide")
            .mapInPandas(_lent(min_group, pool, everyone), "grp string, c array<double>, p array<double>"))
    rows = m.join(sized_broadcast(cut(pick), 20_000), "grp", "left")
    far = F.coalesce(_distance(), F.lit(0.0))
    return (rows.withColumn("distance", far)
            .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(confidence, D))))


def op10(documents: DataFrame) -> DataFrame:
    """Contract query over every document."""
    return judge(documents.select("doc_id", "text", "lang", "source"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")
