"""Incremental capture and validation with Structured Streaming.

The hand-triggered mailbox pass becomes a file stream: every micro-batch is
de-duplicated against the stored mail table (anti join on ``message_id`` --
the original de-duplication is unbounded, so the store is the state) and
appended. ``trigger(availableNow=True)`` processes what has landed and stops,
which is the batch-like behaviour of the original button. Appends are atomic
per micro-batch (file commit protocol) and the anti join makes a replayed
batch write nothing twice, so a lost executor or a restarted query is safe.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.capture import new_messages
from ..session import scratch_path
from ..sources.tables import read_driver

STORE_COLUMNS = ["message_id", "seq", "remetente", "recebido_em", "corpo_email", "n_anexos"]


def is_paused(flags: DataFrame, key: str = "pausar_pipeline") -> DataFrame:
    """One-row DataFrame ``pausado`` -- flag value 'true' in any case."""
    f = flags.filter(F.col("chave") == key)
    return f.agg(F.coalesce(F.max(F.lower(F.col("valor")) == "true"), F.lit(False))
                 .alias("pausado"))


def _stored(spark: SparkSession, path: str, template: DataFrame) -> DataFrame:
    """The store; empty if nothing was stored yet. Any other failure to read it is raised."""
    try:
        return spark.read.schema(template.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return template.limit(0)


def capture_batch(batch: DataFrame, store_path: str, address: str,
                  existing: DataFrame | None = None) -> None:
    """One micro-batch: accepted, first-seen, not-yet-stored messages are appended."""
    spark = batch.sparkSession
    stored = _stored(spark, store_path, batch.select(*STORE_COLUMNS))
    known = stored.select("message_id")
    if existing is not None:
        known = known.unionByName(existing.select("message_id"))
    fresh = new_messages(batch, known, address).select(*STORE_COLUMNS)
    fresh.write.mode("append").parquet(store_path)


def landed_from_events(events: DataFrame) -> DataFrame:
    """Landed-message rows as the capture sees them, from the event stream."""
    eid, uid = F.col("event_id"), F.col("user_id")
    return events.select(
        eid.alias("seq"),
        F.concat(F.lit("<"), uid.cast("string"), F.lit("-"), F.col("event_type"),
                 F.lit("@fixture.example>")).alias("message_id"),
        F.when(uid % 5 == 0, F.lit("Outro@example.com"))
         .otherwise(F.lit("Respostas@Example.com")).alias("remetente"),
        F.col("ts").alias("recebido_em"),
        F.when(eid % 9 == 0, F.lit(None).cast("string")).when(eid % 9 == 1, F.lit("  curto  "))
         .otherwise(F.concat(F.lit("corpo da mensagem "), eid.cast("string"),
                             F.lit(" com texto suficiente"))).alias("corpo_email"),
        (eid % 4).cast("int").alias("n_anexos"))


def run_capture_stream(spark: SparkSession, sf_dir: str, address: str,
                       run_name: str | None = None) -> DataFrame:
    """R1 over the driver's event file: stream it, capture each micro-batch
    into a store under the shared checkpoint folder, return the store."""
    import uuid

    name = run_name or f"capture-{uuid.uuid4().hex[:12]}"
    store = scratch_path(spark, f"{name}/emails")
    ckpt = scratch_path(spark, f"{name}/_checkpoint")
    schema = read_driver(spark, sf_dir, "events").schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    orders = read_driver(spark, sf_dir, "orders")
    existing = orders.select(F.concat(F.lit("<"), F.col("o_orderkey").cast("string"),
                                      F.lit("@fixture.example>")).alias("message_id"))
    landed = landed_from_events(events)
    q = (landed.writeStream
         .foreachBatch(lambda df, _epoch: capture_batch(df, store, address, existing))
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return spark.read.parquet(store)
