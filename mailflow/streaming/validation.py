"""Incremental validation (R2): each micro-batch of newly stored mails is
validated and its outputs appended.

Cases are appended to the case store after an anti join with the store, so a
replayed micro-batch appends nothing twice. Reply rows go to an append-only
log; the reply table is the log merged onto the base table on read
(``current_replies``: last row per mail wins, then the keyed upsert).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation as VA
from ..operators.upsert import last_per_key
from ..session import scratch_path


def validation_batch(mails: DataFrame, cases_path: str, replies_log: str, anexos: DataFrame,
                     texts: DataFrame | None, as_of: Column, new_case_key: Column) -> None:
    spark = mails.sparkSession
    cases = spark.read.parquet(cases_path)
    req = VA.backlog_requests(mails, cases, anexos)
    v = VA.verdicts_from_text(req, texts) if texts is not None else \
        VA.verdicts_from_rules(req, anexos)
    # One scan of the batch's verdicts feeds both outputs.
    v = v.checkpoint(eager=True)
    VA.reply_rows(v, as_of).write.mode("append").parquet(replies_log)
    VA.protocol_rows(v, cases, as_of, new_case_key).write.mode("append").parquet(cases_path)


def current_replies(base: DataFrame, replies_log: DataFrame, new_key: Column) -> DataFrame:
    """The reply table: base rows with the logged reply rows upserted."""
    latest = last_per_key(replies_log, "id_email", [F.col("data_chegada")])
    return VA.apply_replies(base, latest, new_key)


def run_validation_stream(spark: SparkSession, tables, as_of: Column,
                          new_case_key: Column, use_texts: bool = True) -> tuple[str, str]:
    """Stream the stored mail table through validation; returns the case
    store and reply log paths. ``tables`` is a ``StoredFixtures``."""
    name = f"validation-{uuid.uuid4().hex[:12]}"
    cases_path = scratch_path(spark, f"{name}/protocolos")
    replies_log = scratch_path(spark, f"{name}/respostas_log")
    ckpt = scratch_path(spark, f"{name}/_checkpoint")
    tables.protocolos.write.parquet(cases_path)
    mails_path = tables.store("emails")
    schema = spark.read.parquet(mails_path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(mails_path)
    anexos = tables.anexos_email
    texts = tables.ia_respostas if use_texts else None
    q = (stream.writeStream
         .foreachBatch(lambda df, _e: validation_batch(df, cases_path, replies_log, anexos,
                                                        texts, as_of, new_case_key))
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return cases_path, replies_log
