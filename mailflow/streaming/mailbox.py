"""Capture of raw mail as a stream of landed files into several tables under one batch id.

Files (``.eml``, or bundles of many messages) are read by the ``binaryFile``
source, each micro-batch is parsed once into a staging folder, and mails,
attachments, quality rows and outcomes are written to ``{table}/lote={id}``.
Last comes the batch's commit row with its totals; readers see committed
batches only (``read_captured``), so the tables change together. A batch that
runs again overwrites its own folders, and writes nothing if its commit row
stands, so lost executors and restarts repeat nothing.

Pausing: the gate is read at the start of every micro-batch. A paused batch
ends the query before its offsets are committed; the next run takes the same
files again.

Progress: a listener appends one row per micro-batch (files, duration) to a
table; ``progress_table`` joins it with the committed totals.

De-duplication is against all committed mails (unbounded, one column of the
store). ``bounded_mail_stream`` is the bounded form: watermark state forgets an
id once the watermark passes it, so a repeat that comes later than ``delay``
after the first is stored again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.mailbox import capture_pass, landed_messages, pass_outcomes, pass_totals, stored_mails
from ..sources.mailparse import parse_mailbox, read_landed_mail
from .capture import is_paused

LANDED = "*.{eml,mbox,txt}"
COMMITS, PROGRESS = "lotes", "progresso"
PROGRESS_ROW = "execucao string, lote long, n_arquivos long, duracao_ms long, em string"


class CapturePaused(Exception):
    """The control flag asks for a pause; the batch was not started."""


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or None if nothing was written yet; other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def committed(spark: SparkSession, base: str) -> DataFrame | None:
    """Commit rows ``lote, total, salvos, duplicados, falhas, ignorados``."""
    return _read(spark, f"{base}/{COMMITS}")


def read_captured(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The rows of committed batches of a captured table."""
    rows, commits = _read(spark, f"{base}/{table}"), committed(spark, base)
    if rows is None or commits is None:
        return None
    return rows.join(commits.select("lote"), "lote", "left_semi")


def capture_batch(files: DataFrame, lote: int, base: str, address: str, as_of: Column,
                  existing: DataFrame | None = None) -> None:
    """Captures the messages of one micro-batch of landed files into the tables under ``base``."""
    spark = files.sparkSession
    commits = committed(spark, base)
    if commits is not None and not commits.where(F.col("lote") == lote).isEmpty():
        return  # this batch was committed by an earlier run
    staged = f"{base}/_preparo/lote={lote}"
    landed_messages(parse_mailbox(files), as_of).write.mode("overwrite").parquet(staged)
    messages = spark.read.parquet(staged)
    known = [df.select("message_id") for df in (read_captured(spark, base, "emails"), existing) if df is not None]
    known = known[0].unionByName(known[1]) if len(known) == 2 else known[0] if known else messages.select("message_id").limit(0)
    outcomes_at = f"{base}/resultados/lote={lote}"
    pass_outcomes(messages, known, address).write.mode("overwrite").parquet(outcomes_at)
    outcomes = spark.read.parquet(outcomes_at)
    for table, rows in capture_pass(messages, outcomes).items():
        if table != "resultados":
            rows.write.mode("overwrite").parquet(f"{base}/{table}/lote={lote}")
    pass_totals(outcomes).coalesce(1).write.mode("overwrite").parquet(f"{base}/{COMMITS}/lote={lote}")


class ProgressTable(StreamingQueryListener):
    """Appends a row for each micro-batch with input of one query to ``{base}/progresso``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.query_id, self.ended = spark, base, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) == self.query_id and p.numInputRows > 0:
            row = [(str(p.runId), p.batchId, p.numInputRows, p.batchDuration, p.timestamp)]
            self.spark.createDataFrame(row, PROGRESS_ROW).coalesce(1).write.mode("append").parquet(f"{self.base}/{PROGRESS}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.ended.set()


def run_capture(spark: SparkSession, landing: str, base: str, address: str, as_of: Column,
                existing: DataFrame | None = None, flags: Callable[[], DataFrame] | None = None,
                max_files: int | None = None) -> str:
    """Captures what has landed and stops: ``finalizado``, or ``pausado`` if the gate closed before the end.

    ``flags`` gives the control table (``chave, valor``) as it is now.
    """
    reader = read_landed_mail(spark, landing, LANDED, streaming=True, max_files=max_files)
    closed = []

    def batch(files: DataFrame, lote: int) -> None:
        if flags is not None and is_paused(flags()).first().pausado:
            closed.append(lote)
            raise CapturePaused(f"batch {lote} waits")
        capture_batch(files, lote, base, address, as_of, existing)

    listener = ProgressTable(spark, base)
    spark.streams.addListener(listener)
    try:
        q: StreamingQuery = (reader.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/_posicao")
                             .trigger(availableNow=True).start())
        listener.query_id = str(q.id)
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if not closed:
                raise
        listener.ended.wait(60)  # events come after the query's end
    finally:
        spark.streams.removeListener(listener)
    return "pausado" if closed else "finalizado"


def progress_table(spark: SparkSession, base: str) -> DataFrame:
    """One row per committed batch, with running ``atual`` (index of the last message handled, from 0)."""
    seen = _read(spark, f"{base}/{PROGRESS}")
    commits = committed(spark, base)
    # A batch that was committed, failed in the engine and ran again has several events: the first did the work.
    seen = seen.groupBy("lote").agg(F.min_by(F.struct("n_arquivos", "duracao_ms", "em"), "em").alias("_e"))
    so_far = Window.orderBy("lote").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per batch
    return (commits.join(seen, "lote", "left")
            .withColumn("atual", F.sum("total").over(so_far) - 1)
            .select("lote", "_e.n_arquivos", "_e.duracao_ms", "_e.em", "total", "salvos", "duplicados", "falhas",
                    "ignorados", "atual"))


def bounded_mail_stream(spark: SparkSession, landing: str, address: str, as_of: Column, delay: str = "30 days",
                        max_files: int | None = None) -> DataFrame:
    """Accepted mails as a streaming DataFrame, ids held back within ``delay`` of event time only."""
    parsed = landed_messages(parse_mailbox(read_landed_mail(spark, landing, LANDED, streaming=True, max_files=max_files)), as_of)
    accepted = parsed.where((F.lower("remetente") == address.lower()) & F.col("erro_parse").isNull())
    timed = accepted.withColumn("_quando", F.col("recebido_em").cast("timestamp")).withWatermark("_quando", delay)
    return stored_mails(timed.dropDuplicatesWithinWatermark(["message_id"]))
