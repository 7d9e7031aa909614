"""Range upserts, page joins with a hot mail, the scorer's rows, case detail rows."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailflow.functions.verdict import NO_ANSWER, parse_scored, score_with
from mailflow.operators import boards as B
from mailflow.operators.common import left_join_bounded
from mailflow.plans.workflow_queries import rule_scorer
from mailflow.sinks.partitioned import RANGE, read_ranges, replace_partitions, upsert_ranges, write_ranges


def files_of(path):
    return {os.path.join(os.path.relpath(d, path), f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


# -- range upserts ------------------------------------------------------------------
@pytest.fixture()
def table(spark, scratch):
    rows = [(i, f"v{i}", 1000 + i) for i in range(100)] + [(None, "none", 7)]
    return write_ranges(spark.createDataFrame(rows, "k long, v string, id long"), f"{scratch}/t", "k", 10)


def test_untouched_ranges_keep_their_files(spark, table):
    before = files_of(table)
    source = spark.createDataFrame([(12, "new"), (15, None), (205, "added")], "k long, v string")
    touched = upsert_ranges(spark, table, source, "k", ["v"], 10, new_key=F.col("k") + 5000, key_col="id")
    assert touched == [1, 20]
    after = files_of(table)
    assert {f for f in before if f"{RANGE}=1/" not in f} == {f for f in after if f"{RANGE}=1/" not in f and f"{RANGE}=20/" not in f}
    assert not {f for f in before if f"{RANGE}=1/" in f} & after
    got = {r.k: (r.v, r.id) for r in read_ranges(spark, table).collect()}
    assert len(got) == 102 and got[12] == ("new", 1012) and got[15] == (None, 1015) and got[205] == ("added", 5205)
    assert got[None] == ("none", 7) and got[13] == ("v13", 1013)


def test_update_only_and_empty_sources(spark, table):
    before = files_of(table)
    assert upsert_ranges(spark, table, spark.createDataFrame([], "k long, v string"), "k", ["v"], 10) == []
    assert files_of(table) == before
    source = spark.createDataFrame([(33, "x"), (999, "y"), (None, "z")], "k long, v string")
    assert upsert_ranges(spark, table, source, "k", ["v"], 10, insert=False) == [3, 99]
    got = {r.k: r.v for r in read_ranges(spark, table).collect()}
    assert len(got) == 101 and got[33] == "x" and 999 not in got and got[None] == "none"


def test_replacing_again_gives_the_same_table(spark, table, scratch):
    staged = read_ranges(spark, table, [2]).withColumn("v", F.upper("v"))
    staged.write.parquet(f"{scratch}/novas")
    for _ in range(2):
        replace_partitions(spark.read.parquet(f"{scratch}/novas"), table)
        got = {r.k: r.v for r in read_ranges(spark, table).collect()}
        assert len(got) == 101 and got[25] == "V25" and got[35] == "v35"


def test_only_touched_ranges_are_read(spark, table):
    df = read_ranges(spark, table, [1, 4])
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and f"{RANGE}#" in plan.split("PartitionFilters")[1][:60]
    assert {r[0] for r in df.select(F.regexp_extract(F.input_file_name(), f"{RANGE}=(-?\\d+)", 1)).distinct().collect()} == {"1", "4"}


# -- page joins ---------------------------------------------------------------------
def test_hot_mail_is_not_brought_together(spark):
    page = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "id_email long, x string").checkpoint()
    hot = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id") + 10)).cast("long").alias("_aid"),
                                     F.col("id").alias("id_anexo")).repartition(8)
    out = left_join_bounded(page, hot, "id_email", "_aid", 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    tasks = out.where("id_email = 2").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 20_000 / 3
    got = out.groupBy("id_email", "x").agg(F.count("id_anexo").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(r.id_email, r.x): (r.n, r.rows) for r in got} == {
        (1, "a"): (0, 1), (2, "b"): (10_000, 10_000), (2, "c"): (10_000, 10_000), (3, "d"): (0, 1), (None, "e"): (0, 1)}
    assert out.columns == ["id_email", "x", "id_anexo"]


# -- scorer -------------------------------------------------------------------------
def scored(spark, df, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = parse_scored(score_with(df, rule_scorer)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_scorer_results_do_not_depend_on_batches(spark):
    df = spark.range(400).select(F.col("id").alias("id_email"), F.lit("p").alias("prompt")).coalesce(1)
    one = scored(spark, df, 1)
    assert one == scored(spark, df, 1000) and len(one) == 400
    got = {r.id_email: r for r in score_with(df, rule_scorer).collect()}
    for i, r in got.items():
        want = "tempo esgotado" if i % 11 == 4 else NO_ANSWER if i % 13 == 6 else None
        assert r.erro_chamada == want and (r.conteudo is None) == (want is not None)


def test_scorer_that_always_fails_and_empty_input(spark):
    def fails(rows: pd.DataFrame) -> pd.DataFrame:
        raise OSError("fora do ar")

    df = spark.range(7).select(F.col("id").alias("id_email"), F.lit("p").alias("prompt"))
    assert [r.erro_chamada for r in score_with(df, fails).collect()] == ["fora do ar"] * 7
    assert score_with(df.limit(0), fails).count() == 0


# -- case detail ----------------------------------------------------------------------
def test_case_detail_rows_are_ordered_and_restricted(spark, tables):
    ids = tables.emails.select("id_email").orderBy("id_email").limit(3)
    rows = B.case_detail_rows(tables.emails, tables.respostas, tables.anexos_email, tables.protocolos, ids, 3).collect()
    keys = [(r.id_email, B.DETAIL_SECTIONS.index(r.secao), r.id) for r in rows]
    assert keys == sorted(keys) and len({r.id_email for r in rows}) == 3
    assert sum(r.secao == "email" for r in rows) == 3 and any(r.secao == "anexo" for r in rows)
    plan = B.case_detail_rows(tables.emails, tables.respostas, tables.anexos_email, tables.protocolos)
    assert "rangepartitioning(id_email" in plan._jdf.queryExecution().executedPlan().toString()


# -- identifiers in attachments ---------------------------------------------------------
def test_identifiers_are_matched_in_names_and_text(spark):
    from mailflow.operators.evidence import extension_asked, identifier_evidence
    case = "0000123-45.1998.8.26.0001"
    mails = spark.createDataFrame(
        [(1, case, "77", "FNDA-000123", "DILAÇÃO"), (2, case, None, "DILA-654321", "DILAÇÃO"), (3, None, None, None, None),
         (4, " ", "", "--", "RESPOSTA FINAL"), (5, case, "77", None, None)],
        "id_email long, processo string, opaj string, identificador string, status_final string")
    names = spark.createDataFrame(
        [(1, "Minuta 0000123 45.1998.8.26-0001.pdf"), (1, "opaj_77_fnda 000123.pdf"), (2, "minuta dila654321.pdf"),
         (5, "minuta 1770 00001234519988260001.pdf"), (5, None), (9, "FNDA-000123")], "id_email long, nome_arquivo string")
    texts = spark.createDataFrame([(2, f"processo {case}"), (1, "pede Dilação de prazo de 10 dias"), (5, None)],
                                  "id_email long, texto string")
    cols = ["processo_ok", "opaj_ok", "identificador_ok", "ids_ok"]
    got = {r.id_email: tuple(r[c] for c in cols) for r in identifier_evidence(mails, names).collect()}
    assert got == {1: (True, True, True, True), 2: (False, None, True, False), 3: (None, None, None, True),
                   4: (None, None, None, True), 5: (True, False, None, False)}  # 77 inside 1770 is no match
    got = {r.id_email: r.ids_ok for r in identifier_evidence(mails, names, texts).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False}
    got = {r.id_email: r.pedido_ok for r in extension_asked(mails, texts).collect()}
    assert got == {1: True, 2: False, 3: None, 4: None, 5: None}


def test_received_time_zones_and_weekdays(spark):
    from mailflow.functions.extract import received_time
    heads = ["Thu, 02 May 1996 10:00:00 -0300", "thu, 2 may 1996 10:00:00 -03:00", "Thu, 02 May 1996 13:00:00 Z",
             "Xyz, 02 May 1996 10:00:00 -0300", "Thu, 02 May 1996 10:00:00", "Thu, 02 Foo 1996 10:00:00 +0000", None]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    got = [str(r.t) for r in df.select(received_time("h", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("t")).collect()]
    assert got == ["1996-05-02 13:00:00"] * 3 + ["2026-01-01 00:00:00"] * 4
