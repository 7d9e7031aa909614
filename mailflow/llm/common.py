"""Shared helpers of the training-data operators.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` splits
on exactly these six ASCII white-space bytes, and ``bytes.lower()`` lowers
exactly A-Z, so both rules of the contracts are plain bytes methods.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (a null counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


_scratch: list[str] | None = None  # paths to give back, while a scratch scope is open


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    if _scratch is not None:
        _scratch.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch_scope(paths: list[str]) -> Iterator[None]:
    """Collects the paths that ``stored`` writes inside into ``paths``."""
    global _scratch
    before, _scratch = _scratch, paths
    try:
        yield
    finally:
        _scratch = before


def free(spark: SparkSession, paths: list[str]) -> None:
    """Gives back the disk of written tables by overwriting each with an empty one."""
    while paths:
        spark.createDataFrame([], "freed int").coalesce(1).write.mode("overwrite").parquet(paths.pop())


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of an Arrow batch for the jobs that follow in this session.

    A batch is held several times over: in the JVM, in the worker as Arrow and
    as pandas, and beside its result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def sized_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` hinted for broadcast if a count shows at most ``most`` rows, else as it is (shuffled)."""
    return F.broadcast(df) if df.count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables of an iteration."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash; emptied when full, so its memory is bounded."""

    LIMIT = 100_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``(a, b)`` -> ``(id, component)``.

    ``component`` is the smallest id of the component; only nodes that have an
    edge to another node are returned. Alternates large-star and small-star
    steps; each joins the edges with one minimum per node, so a hub is
    pre-aggregated before the shuffle and its edges are a join side that AQE
    splits. Self loops and null ends are ignored.
    """
    e = cut(edges.where("a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").where("v <> m")
                .select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component")))
        seen = mark
