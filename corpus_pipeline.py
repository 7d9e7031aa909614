"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; other columns, whatever their names,
travel along. ``run`` applies the stages to ``documents``. SQL can't express
the stages, so tests hold them against brute force.

Defined results: rows with null text are rejected by the quality stage; rows
without doc_id are not compared for near-duplicates and stay; of rows that
repeat a doc_id and its text one stays, unlike texts under one doc_id all stay;
an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailflow.llm import minhash, mixing, pii, quality, sentencepiece_bpe
from mailflow.llm.common import bounded_batches, free, scratch_scope
from mailflow.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
USED = ("doc_id", "text", "lang", "source", "n_chars")
_tables: list[str] = []


def _stage(fn: Callable[[DataFrame], DataFrame]) -> Stage:
    """Frees the scratch tables of the stage before, whose result has been written by then."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        if not any(t in f for f in docs.inputFiles() for t in _tables):
            free(spark, _tables)
        with scratch_scope(_tables):
            return fn(docs)
    run.__name__ = fn.__name__
    return run


def _guarded(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """Columns the stages do not use get names that no operator uses; the last item undoes it."""
    inner = {c: c if c in USED else f"carried__{i}" for i, c in enumerate(docs.columns)}
    back = lambda df: df.select(*[F.col(v).alias(c) for c, v in inner.items()])
    return docs.select(*[F.col(f"`{c}`").alias(v) for c, v in inner.items()]), list(inner.values()), back


def good_quality(docs: DataFrame) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, cols, back = _guarded(docs)
    return back(quality.judge(rows, cols).where("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    rows, cols, back = _guarded(docs)
    kept = minhash.representatives(rows).withColumnRenamed("tk", "text__hash")
    chosen = (rows.withColumn("text__hash", F.xxhash64("text")).join(kept, ["doc_id", "text__hash"])
              .groupBy("doc_id", "text__hash")  # repeated rows
              .agg(F.min_by(F.struct(*[c for c in cols if c != "doc_id"]), F.xxhash64(*cols)).alias("row"))
              .select("doc_id", "row.*"))
    return back(chosen.select(*cols).unionByName(rows.where("doc_id is null")))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    rows, _, back = _guarded(docs)
    return back(pii.redact(rows))


def mixed(docs: DataFrame) -> DataFrame:
    """Sources mixed to their targets: a document has a row for each time it is taken."""
    rows, _, back = _guarded(docs)
    sized = rows.withColumns({"size": mixing.word_count(F.col("text")), "quality": mixing.quality(F.col("text"))})
    times = (F.col("epochs") + F.col("extra")).cast("int")
    taken = mixing.mix(sized).where((times > 0) & (F.col("size") > 0))
    return back(taken.withColumn("time", F.explode(F.sequence(F.lit(1), times))))


def encoded(docs: DataFrame) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of their decoding."""
    rows, _, _ = _guarded(docs)
    return sentencepiece_bpe.encode_documents(rows, ["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", _stage(good_quality)),
    ("near_duplicates", _stage(without_near_duplicates)),
    ("personal_data", _stage(without_personal_data)),
    ("mixing", _stage(mixed)),
    ("encoding", _stage(encoded)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
