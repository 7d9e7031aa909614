"""Steps whose folders, batches, files and tasks must not outgrow the tables."""

import os
import re
import shutil

from pyspark.sql import functions as F

from mailflow import schemas
from mailflow.operators import common
from mailflow.operators import validation as VA
from mailflow.operators.upsert import conform_to
from mailflow.plans import workflow_queries as W
from mailflow.sinks.partitioned import RANGE, range_width, write_ranges
from mailflow.sources.fixtures import DERIVED_TABLES, FixtureTables, stored_fixtures
from mailflow.streaming import caselog as L

from .conftest import SF_SMALL


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def rows(df):
    return sorted(map(repr, df.collect()))


def own_store(spark, scratch):
    for name in ("orders", "lineitem", "customer", "events"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", f"{scratch}/{name}.parquet")
    return stored_fixtures(spark, scratch)


def test_only_used_tables_are_stored(spark, scratch):
    t = own_store(spark, scratch)
    t.validacoes.count()
    assert [n for n in DERIVED_TABLES if os.path.exists(f"{t.base}/{n}".removeprefix("file:"))] == ["validacoes"]


def test_tables_stored_from_clustered_sources(spark, tables, scratch, monkeypatch):
    from mailflow.sources import fixtures as S
    monkeypatch.setattr(S, "FILE_ROWS", 20)
    t = own_store(spark, scratch)
    for name, key in S.SORT_KEYS.items():
        stored = getattr(t, name)
        assert rows(stored) == rows(getattr(tables, name))
        per_file = stored.groupBy(F.input_file_name().alias("f")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        spans = sorted((r.lo, r.hi) for r in per_file.collect())
        assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_ranges_are_bounded_in_number(spark, scratch):
    df = spark.range(10_000).select(F.col("id").alias("k")).unionByName(spark.sql("select 10000000L k"))
    assert range_width(df, "k", 10, most=2000) == 10
    width = range_width(df, "k", 10, most=50)
    path = write_ranges(df, f"{scratch}/t", "k", width)
    assert width == 210 and len([d for d in os.listdir(path) if d.startswith(RANGE)]) <= 50
    assert range_width(df.limit(0), "k", 10) == 10


def test_batches_do_not_grow_with_the_mails(spark, tables, scratch):
    base = write_ranges(conform_to(tables.protocolos, schemas.PROTOCOLOS), f"{scratch}/base", "id_email", 250)
    tables.emails.repartition(24).write.parquet(f"{scratch}/mails")
    log = f"{scratch}/log"
    L.run_validation(spark, f"{scratch}/mails", base, log, tables.anexos_email, None, as_of(),
                     F.lit(1000000) + F.col("id_email"), 250)
    assert spark.read.parquet(f"{log}/lotes").count() == L.MOST_BATCHES
    new = L.open_deltas(spark, log, "protocolos")
    want = (tables.emails.where("tipo_email = 'protocolo'").join(tables.protocolos, "id_email", "left_anti"))
    assert rows(new.select("id_email")) == rows(want.select("id_email"))
    per_range = [len([f for f in fs if f.endswith(".parquet")]) for d, _, fs in os.walk(f"{log}/protocolos") if "faixa=" in d]
    assert per_range and set(per_range) == {1}


def test_requests_and_rules_take_tasks_by_their_rows(spark, tables, scratch, monkeypatch):
    tables.anexos_email.write.parquet(f"{scratch}/anexos")
    anexos = spark.read.parquet(f"{scratch}/anexos")
    assert common.spread_count(anexos) is None
    want = [rows(f(tables, anexos)) for f in (_requests, _rules)]
    monkeypatch.setattr(common, "SPREAD_ROWS", 100)
    assert common.spread_count(anexos) == -(-anexos.count() // 100)
    assert [rows(f(tables, anexos)) for f in (_requests, _rules)] == want
    assert _requests(tables, anexos).rdd.getNumPartitions() >= common.spread_count(anexos)


def _requests(t, anexos):
    return VA.backlog_requests(t.emails, t.protocolos, anexos)


def _rules(t, anexos):
    return VA.verdicts_from_rules(_requests(t, anexos), anexos)


def test_landed_files_hold_few_messages_in_mailbox_order(spark, tables, scratch, monkeypatch):
    monkeypatch.setattr(W, "BUNDLE", 7)
    seqs = []
    for wave in range(W.WAVES):
        folder = f"{scratch}/caixa{wave}"
        W.land(spark, tables, folder, wave)
        for name in sorted(f for f in os.listdir(folder) if f.endswith(".txt")):
            found = [int(s) for s in re.findall(rb"boundary=\"==b(\d+)==\"", open(f"{folder}/{name}", "rb").read())]
            assert len(found) <= 7
            seqs += found
    assert seqs == sorted(r.seq for r in tables.captura.select("seq").collect())
