"""Sinks: report export, outcome log, versioned writes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mailflow.operators import boards as B
from mailflow.operators import capture as K
from mailflow.plans.queries import SENDER
from mailflow.sinks.tables import EmptyReport, export_report, write_outcome_log, write_version


def test_report_export_partitions_by_month(spark, tables, scratch):
    rows = B.report_rows(tables.emails, tables.protocolos, tables.respostas,
                         "1996-01-01", "1996-12-31", sort=False)
    path = export_report(rows, os.path.join(scratch, "rel"))
    back = spark.read.option("header", True).csv(path)
    assert back.count() == rows.count()
    months = {r.mes for r in back.select("mes").distinct().collect()}
    assert months and all(m.startswith("1996-") for m in months)


def test_empty_report_raises(spark, tables, scratch):
    rows = B.report_rows(tables.emails, tables.protocolos, tables.respostas,
                         "2100-01-01", "2100-12-31", sort=False)
    with pytest.raises(EmptyReport):
        export_report(rows, os.path.join(scratch, "vazio"))


def test_outcome_log_is_json_lines(spark, tables, scratch):
    o = K.outcomes(tables.captura, tables.emails, SENDER)
    log = K.outcome_log(o, F.lit("2026-01-01 10:00:00").cast("timestamp_ntz"))
    path = write_outcome_log(log, os.path.join(scratch, "log"))
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    first = json.loads(open(os.path.join(path, files[0])).readline())
    assert set(first) == {"tipo", "mensagem", "timestamp"}
    assert first["timestamp"] == "2026-01-01 10:00:00"
    assert spark.read.json(path).count() == o.count()


def test_write_version_is_idempotent(spark, scratch):
    df = spark.range(10)
    p1 = write_version(df, scratch, 1)
    p2 = write_version(df, scratch, 1)
    assert p1 == p2 and spark.read.parquet(p1).count() == 10
