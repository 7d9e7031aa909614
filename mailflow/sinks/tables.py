"""Sinks: report export (W9), outcome log (W10), versioned table writes.

Upserts produce a *new* table; it is written to a new version folder and the
caller switches readers to it. A job never reads and overwrites one path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmptyReport(ValueError):
    """Raised when a report has no rows (the endpoint answered 400)."""


def export_report(rows: DataFrame, path: str, fmt: str = "csv",
                  ts_col: str = "recebido_em") -> str:
    """Write report rows partitioned by month of ``ts_col``.

    Distributed write (no single-file pandas frame); CSV with a header or
    parquet. An empty report raises ``EmptyReport`` -- checked with
    ``isEmpty`` (stops at the first row), not a count.
    """
    if rows.isEmpty():
        raise EmptyReport("Nenhum protocolo encontrado.")
    out = rows.withColumn("mes", F.date_format(F.col(ts_col), "yyyy-MM"))
    writer = out.write.mode("overwrite").partitionBy("mes")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def write_outcome_log(log_rows: DataFrame, path: str) -> str:
    """Append JSON-lines records ``{tipo, mensagem, timestamp}``."""
    log_rows.select("tipo", "mensagem", "timestamp").write.mode("append").json(path)
    return path


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a table version to ``{base}/v={version}`` (overwrite of that
    version only, so a retried job is idempotent) and return its path."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path
