"""Validation into a base with deltas: replay, compaction, reads that follow the batch."""

import os

import pytest
from pyspark.sql import functions as F

from mailflow import schemas
from mailflow.operators.upsert import conform_to
from mailflow.sinks.partitioned import read_ranges, write_ranges
from mailflow.streaming import caselog as L

WIDTH = 250


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def key():
    return F.lit(1000000) + F.col("id_email")


@pytest.fixture()
def base(tables, scratch):
    return write_ranges(conform_to(tables.protocolos, schemas.PROTOCOLOS), f"{scratch}/base", "id_email", WIDTH)


def batch(tables, mails, lote, base, log):
    L.validate_batch(mails, lote, base, log, tables.anexos_email, None, as_of(), key(), WIDTH)


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_batches_replay_and_compaction(spark, tables, base, scratch):
    log = f"{scratch}/log"
    before = files(base)
    low, high = tables.emails.where("id_email < 500"), tables.emails.where("id_email >= 500 and id_email < 900")
    batch(tables, low, 0, base, log)
    written = files(log)
    batch(tables, low, 0, base, log)  # committed: nothing
    assert files(log) == written and files(base) == before
    batch(tables, tables.emails.where("id_email < 900"), 1, base, log)  # half of it has cases in the first delta
    new = L.open_deltas(spark, log, "protocolos").select("lote", "id_email").collect()
    want = (tables.emails.where("tipo_email = 'protocolo' and id_email < 900")
            .join(tables.protocolos, "id_email", "left_anti").select("id_email").collect())
    assert sorted(r.id_email for r in new) == sorted(r.id_email for r in want) and want
    assert {r.lote for r in new if r.id_email < 500} == {0} and {r.lote for r in new if r.id_email >= 500} == {1}
    now = sorted(map(repr, L.current_cases(spark, base, log).drop("faixa").collect()))
    assert L.compact(spark, base, log) == [0, 1, 2, 3]
    assert L.open_deltas(spark, log, "protocolos").count() == 0
    assert sorted(map(repr, read_ranges(spark, base).drop("faixa").collect())) == now
    assert sorted(map(repr, L.current_cases(spark, base, log).drop("faixa").collect())) == now
    assert [f for f in before if "faixa=4/" in f or "faixa=5/" in f] == [f for f in files(base) if "faixa=4/" in f or "faixa=5/" in f]
    assert L.compact(spark, base, log) == []
    batch(tables, high, 2, base, log)  # all have cases by now
    assert L.open_deltas(spark, log, "protocolos").count() == 0


def test_lost_batches_are_not_seen_and_folded_rows_not_doubled(spark, tables, base, scratch):
    log = f"{scratch}/log"
    batch(tables, tables.emails.where("id_email < 300"), 0, base, log)
    n = L.current_cases(spark, base, log).count()
    os.makedirs(f"{log}/protocolos/lote=9/faixa=1")
    spark.read.parquet(f"{log}/protocolos/lote=0/faixa=0").write.mode("overwrite").parquet(f"{log}/protocolos/lote=9/faixa=0")
    assert L.current_cases(spark, base, log).count() == n
    # A compaction that replaced the ranges but was lost before it marked the batch.
    L.replace_partitions(L.current_cases(spark, base, log, [0, 1]).checkpoint(), base)
    assert L.current_cases(spark, base, log).count() == n
    L.compact(spark, base, log)
    assert read_ranges(spark, base).count() == n


def test_batches_without_mails_or_backlog(spark, tables, base, scratch):
    log = f"{scratch}/log"
    batch(tables, tables.emails.limit(0), 0, base, log)
    batch(tables, tables.emails.where("tipo_email <> 'protocolo'"), 1, base, log)
    assert L.current_cases(spark, base, log).count() == read_ranges(spark, base).count()
    assert L.compact(spark, base, log) == []
