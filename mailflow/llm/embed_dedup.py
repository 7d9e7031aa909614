"""Embedding near-duplicates by product quantisation, inverted lists and exact rerank.

Vectors are scaled to length 1 in double precision; equal vectors of a label
form a class, and one of each class is searched. A coarse quantiser (k-means)
and residual codebooks for ``SUBSPACES`` subspaces are fitted on a bounded
sample (``sample`` vectors with the smallest hash values); every vector is then
indexed in the inverted list of its nearest centroid, by label.

A pair with cosine >= t lies at most R = sqrt(2 - 2 t) apart. Sufficient
probes: vector x visits list c when x is at most R beyond the plane half way
between its own centroid and c, else no vector of list c can be that near, so
no pair is missed. In a list, the squared distance of x to each member's code
comes from lookup tables per subspace (asymmetric distance); as the member's
own coding error e is known, a pair with distance to the code above R + e is
no match; the others are reranked by exact cosine.

A list's members are dealt into blocks of about ``BLOCK``, and its visitors go
to each block, so no list has to fit one task. Per block and vector one row
with its number of links is returned, and a spanning forest of the block's
links, at most one edge a row, never all pairs.

Defined results: a null label, a null vector, a zero vector or one with a null
or non-finite component links with nothing; vectors of other lengths than the
most frequent one are compared among themselves in blocks, by cosine alone; equal vectors of a label are linked; rows that repeat a vec_id are
one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

SUBSPACES, CODES, BLOCK = 8, 64, 2048


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _sq(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.coarse = kmeans(sample, lists, 10, rng)
        res = sample - self.coarse[self.home(sample)]
        d = sample.shape[1]
        edges = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:]))
        self.books = [kmeans(res[:, a:b], CODES, 8, rng) for a, b in self.parts]

    def home(self, x: np.ndarray) -> np.ndarray:
        return _sq(x, self.coarse).argmin(1)

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs to visit: all lists that a vector within ``radius`` may be in."""
        d = _sq(x, self.coarse)
        own = d[np.arange(len(x)), home]
        apart = np.sqrt(_sq(self.coarse, self.coarse))[home]
        near = (d - own[:, None]) <= 2 * apart * radius + 1e-9
        near[np.arange(len(x)), home] = True
        return np.nonzero(near)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the coding error of each vector."""
        res = x - self.coarse[home]
        codes = np.stack([_sq(res[:, a:b], c).argmin(1) for (a, b), c in zip(self.parts, self.books)], 1)
        back = np.concatenate([c[codes[:, i]] for i, c in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((res - back) ** 2).sum(1))

    def distances(self, q: np.ndarray, centroid: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the codes of one list, by table lookup."""
        res = q - self.coarse[centroid]
        total = np.zeros((len(q), len(codes)))
        for i, ((a, b), c) in enumerate(zip(self.parts, self.books)):
            total += _sq(res[:, a:b], c)[:, codes[:, i]]
        return np.sqrt(total)


def links_in_block(index: Index, centroid: int, cosine: float, radius: float,
                   ids: np.ndarray, v: np.ndarray, mult: np.ndarray,
                   q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each query to other members (copies counted), and forest edges of the links."""
    codes, err = index.encode(v, np.full(len(v), centroid)) if centroid >= 0 else (None, None)
    counts, parent = np.zeros(len(q), np.int64), {}

    def find(a):
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    forest = []
    for s in range(0, len(q), 1024):
        if centroid >= 0:
            near = index.distances(q[s:s + 1024], centroid, codes) <= radius + err[None, :] + 1e-7
        else:  # a length that the index was not fitted on: all of the block by cosine
            near = q[s:s + 1024] @ v.T >= cosine - 1e-9
        for i in np.flatnonzero(near.any(1)):
            at = np.flatnonzero(near[i])
            at = at[(v[at] @ q[s + i] >= cosine) & (ids[at] != q_ids[s + i])]
            counts[s + i] = mult[at].sum()
            mine = int(q_ids[s + i])
            for other in ids[at].tolist():
                a, b = find(mine), find(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    forest.append((mine, other))
    return counts, forest


def unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(list(vectors), dtype=np.float64)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(table: DataFrame, vec: str = "embedding", cosine: float = 0.98,
                 sample: int = 20_000, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``table(vec_id, embedding, label)``."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                        F.col(vec).cast("array<double>").alias("v"))
    whole = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall(
        "v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    usable = whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    classes = stored(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vectors")
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    dims = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()["d"]
    picked = classes.where(F.size("v") == dims).orderBy(F.xxhash64("v", F.lit(seed)), "rep").limit(sample).select("v").toPandas()
    lists = int(min(4096, max(1, n // 8192), len(picked)))
    index = spark.sparkContext.broadcast(Index(unit(picked["v"])[1], lists, seed))
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    label_type = classes.schema["label"].dataType.simpleString()

    def place(batches):
        for whole in batches:
            sizes = whole["v"].map(len).to_numpy()
            other = whole[sizes != dims]  # one list for each other length, numbered below zero
            if len(other):
                yield pd.DataFrame({"label": other["label"], "list": -sizes[sizes != dims], "own": True,
                                    "rep": other["rep"], "m": other["m"], "v": other["v"]})
            whole = whole[sizes == dims]
            for i in range(0, len(whole), 512):  # a vector may visit many lists
                b = whole.iloc[i:i + 512]
                x = unit(b["v"])[1]
                home = index.value.home(x)
                at, to = index.value.probes(x, home, radius)
                yield pd.DataFrame({"label": b["label"].to_numpy()[at], "list": to, "own": to == home[at],
                                    "rep": b["rep"].to_numpy()[at], "m": b["m"].to_numpy()[at],
                                    "v": [b["v"].iloc[i] for i in at]})

    placed = stored(classes.mapInPandas(place, f"label {label_type}, list int, own boolean, rep long, m long, v array<double>"), "placed")
    sizes = (placed.where("own").groupBy("label", "list").agg(F.count("*").alias("c"))
             .select("label", "list", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    tagged = placed.join(sizes, ["label", "list"])
    members = tagged.where("own").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("part", F.lit(0))
    # A visitor goes to each block of its list; blocks of visitors are dealt out as well.
    visitors = tagged.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", F.lit(False))
    busy = visitors.groupBy("label", "list", "block").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    visitors = (visitors.join(busy, ["label", "list", "block"])
                .withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")).drop("parts"))
    members = (members.join(busy, ["label", "list", "block"]).drop("part")
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    cols = ["label", "list", "block", "part", "own", "rep", "m", "v"]

    def search(key, g):
        mem, ask = g[g["own"]], g[~g["own"]]
        if not len(mem) or not len(ask):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        counts, forest = links_in_block(index.value, int(key[1]), cosine, radius, mem["rep"].to_numpy(), unit(mem["v"])[1],
                                        mem["m"].to_numpy(), ask["rep"].to_numpy(), unit(ask["v"])[1])
        some = np.flatnonzero(counts)
        reps = ask["rep"].to_numpy()[some]
        return pd.DataFrame({"a": [*reps, *(a for a, _ in forest)], "b": [*reps, *(b for _, b in forest)],
                             "links": [*counts[some], *([0] * len(forest))]})

    found = stored(members.select(*cols).unionByName(visitors.select(*cols))
                   .groupBy("label", "list", "block", "part").applyInPandas(search, "a long, b long, links long"), "links")
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    named = components(found.where("a <> b").select("a", "b"))
    classes = (classes.join(linked, "rep", "left").join(named.withColumnRenamed("id", "rep"), "rep", "left")
               .select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    good = rows.where("ok").join(classes, ["label", "v"], "left")
    out = good.unionByName(rows.where(~F.coalesce("ok", F.lit(False))), allowMissingColumns=True)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6(embeddings: DataFrame) -> DataFrame:
    """Contract query over every vector."""
    return near_vectors(embeddings)


SQL = r"""
WITH RECURSIVE good AS (
 SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
 SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
direct AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id,
 e.vec_id <= coalesce(l.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low l ON l.x = e.vec_id LEFT JOIN direct d ON d.x = e.vec_id"""
