"""Incremental validation into a base table with a log of deltas (R2).

The case table stays where it is, kept in ranges of ``id_email``
(``sinks.partitioned``). Each micro-batch of mails looks up only the ranges its
mails fall into, in the base and in the deltas, validates the mails without a
case, and writes its new cases and replies as one delta under its batch id; a
commit row makes the delta visible. Nothing is copied, and a batch's reads
follow its mails. A batch that runs again overwrites its own delta, or writes
nothing once it is committed.

``compact`` folds the committed deltas into the ranges they touch and marks
them; a compaction that was cut off can be run again, as reading leaves out
delta rows whose mail the base already has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation as VA
from ..session import scratch_path
from ..sinks.partitioned import RANGE, key_range, read_ranges, replace_partitions
from .mailbox import _read

COMMITS, FOLDED = "lotes", "compactados"
MOST_BATCHES = 4  # of a run over all mails


def open_deltas(spark: SparkSession, log: str, table: str) -> DataFrame | None:
    """Delta rows of committed batches that are not folded into the base yet."""
    rows, commits, folded = (_read(spark, f"{log}/{t}") for t in (table, COMMITS, FOLDED))
    if rows is None or commits is None:
        return None
    if folded is not None:
        commits = commits.join(folded.select("lote"), "lote", "left_anti")
    return rows.join(commits.select("lote"), "lote", "left_semi")


def current_cases(spark: SparkSession, base: str, log: str, ranges: list[int] | None = None) -> DataFrame:
    """The case table as it is now: the base and the open deltas, or some ranges of both."""
    stored = read_ranges(spark, base, ranges)
    new = open_deltas(spark, log, "protocolos")
    if new is None:
        return stored
    if ranges is not None:
        new = new.where(F.col(RANGE).isin(ranges))
    new = new.join(stored.select(RANGE, "id_email").distinct(), [RANGE, "id_email"], "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def case_mails(spark: SparkSession, base: str, log: str, ranges: list[int]) -> DataFrame:
    """``id_email`` of the cases in some ranges of the base and the open deltas, repeats included."""
    stored, new = read_ranges(spark, base, ranges), open_deltas(spark, log, "protocolos")
    mails = stored.select("id_email")
    return mails if new is None else mails.unionByName(new.where(F.col(RANGE).isin(ranges)).select("id_email"))


def validate_batch(mails: DataFrame, lote: int, base: str, log: str, anexos: DataFrame, texts: DataFrame | None,
                   as_of: Column, new_case_key: Column, width: int) -> None:
    """Validates one micro-batch of mails; its delta and commit row are written once."""
    spark = mails.sparkSession
    commits = _read(spark, f"{log}/{COMMITS}")
    if commits is not None and not commits.where(F.col("lote") == lote).isEmpty():
        return
    mails = mails.checkpoint(eager=True)  # the batch's own rows: read by the lookups and the verdicts
    bounds = mails.agg(F.min("id_email").alias("lo"), F.max("id_email").alias("hi"),
                       F.collect_set(key_range("id_email", width)).alias("ranges")).first()  # ranges: at most the base's folders
    cases = case_mails(spark, base, log, bounds.ranges)
    near = F.col("id_email").between(bounds.lo, bounds.hi) if bounds.lo is not None else F.lit(False)
    requests = VA.backlog_requests(mails, cases, anexos.where(near))
    verdicts = VA.verdicts_from_text(requests, texts.where(near)) if texts is not None else \
        VA.verdicts_from_rules(requests, anexos.where(near))
    verdicts = verdicts.checkpoint(eager=True)
    new = VA.protocol_rows(verdicts, cases, as_of, new_case_key).withColumn(RANGE, key_range("id_email", width))
    new.repartition(RANGE).write.mode("overwrite").partitionBy(RANGE).parquet(f"{log}/protocolos/lote={lote}")
    VA.reply_rows(verdicts, as_of).write.mode("overwrite").parquet(f"{log}/respostas/lote={lote}")
    total = verdicts.agg(F.count(F.lit(1)).alias("validados"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{log}/{COMMITS}/lote={lote}")


def run_validation(spark: SparkSession, mails_path: str, base: str, log: str, anexos: DataFrame, texts: DataFrame | None,
                   as_of: Column, new_case_key: Column, width: int, max_files: int = 2) -> None:
    """Validates the mails that have been stored at ``mails_path`` since the last run.

    A batch takes ``max_files`` files, or a share ``1 / MOST_BATCHES`` of all
    where that is more: a batch whose mails lie in all ranges reads the keys of
    the whole base, so the number of such readings must not grow with it.
    """
    mails = spark.read.parquet(mails_path)
    schema = mails.schema
    max_files = max(max_files, -(-len(mails.inputFiles()) // MOST_BATCHES))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(mails_path)
    q = (stream.writeStream
         .foreachBatch(lambda df, lote: validate_batch(df, lote, base, log, anexos, texts, as_of, new_case_key, width))
         .option("checkpointLocation", f"{log}/_posicao").trigger(availableNow=True).start())
    q.awaitTermination()


def compact(spark: SparkSession, base: str, log: str) -> list[int]:
    """Folds the open deltas into the base's touched ranges; gives these ranges."""
    new = open_deltas(spark, log, "protocolos")
    if new is None:
        return []
    staging = scratch_path(spark, f"compactar-{uuid.uuid4().hex}")
    batches = new.select("lote").distinct()
    batches.write.parquet(f"{staging}/lotes")
    touched = sorted(r[0] for r in new.select(RANGE).distinct().collect())
    if touched:
        current_cases(spark, base, log, touched).write.parquet(f"{staging}/faixas")
        replace_partitions(spark.read.parquet(f"{staging}/faixas"), base)
    spark.read.parquet(f"{staging}/lotes").coalesce(1).write.mode("append").parquet(f"{log}/{FOLDED}")
    return touched
