"""Keyed upserts that rewrite only the partitions their source touches.

A table is kept as parquet folders of key ranges (``faixa`` = key div width).
An upsert lists the ranges of its source (at most the number of partitions),
reads only these (static partition pruning), merges them with the source in one
join and replaces them by a dynamic partition overwrite; all other files keep
their names. The merged rows are staged first: if the job is lost while it
replaces folders, ``replace_partitions`` on the staged rows completes it, any
number of times.

A range holds at most ``width`` keys, so no task writes more than that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from ..session import scratch_path

RANGE = "faixa"
MOST_RANGES = 500  # folders of a table: its listing and each batch's files stay bounded


def key_range(key: str, width: int) -> Column:
    """The range of a key; rows without a key share the range -1."""
    return F.coalesce(F.floor(F.col(key) / width), F.lit(-1)).cast("long")


def range_width(df: DataFrame, key: str, least: int, most: int = MOST_RANGES) -> int:
    """The width of a table's ranges: ``least`` keys, or the multiple of it that gives about ``most`` folders."""
    ranges = df.select(key_range(key, least).alias(RANGE)).agg(F.count_distinct(RANGE)).first()[0]
    return least * max(1, -(-ranges // most))


def write_ranges(df: DataFrame, path: str, key: str, width: int) -> str:
    """Writes a table as folders of key ranges."""
    out = df.withColumn(RANGE, key_range(key, width))
    out.repartition(RANGE).write.mode("overwrite").partitionBy(RANGE).parquet(path)
    return path


def read_ranges(spark: SparkSession, path: str, ranges: list[int] | None = None) -> DataFrame:
    """The table, or only some of its ranges (the other folders are not listed as input)."""
    df = spark.read.option("basePath", path).parquet(path)
    return df if ranges is None else df.where(F.col(RANGE).isin(ranges))


def replace_partitions(staged: DataFrame, path: str) -> None:
    """Replaces the ranges that ``staged`` holds; the same result however often it runs."""
    (staged.repartition(RANGE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RANGE).parquet(path))


def upsert_ranges(spark: SparkSession, path: str, source: DataFrame, key: str, update_cols: list[str], width: int,
                  new_key: Column | None = None, key_col: str | None = None, insert: bool = True) -> list[int]:
    """Insert-or-update ``source`` (one row per key) into the table at ``path``; gives the ranges it replaced."""
    staging = scratch_path(spark, f"faixas-{uuid.uuid4().hex}")
    source.select(key, *update_cols).where(F.col(key).isNotNull()).write.parquet(f"{staging}/origem")
    rows = spark.read.parquet(f"{staging}/origem")
    touched = sorted(r[0] for r in rows.select(key_range(key, width)).distinct().collect())
    if not touched:
        return []
    target = read_ranges(spark, path, touched).drop(RANGE)
    merged = upsert(target, rows, key, update_cols, new_key=new_key, key_col=key_col, insert=insert)
    merged.withColumn(RANGE, key_range(key, width)).write.parquet(f"{staging}/novas")
    replace_partitions(spark.read.parquet(f"{staging}/novas"), path)
    return touched
