"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from mailflow.sources.tables import DRIVER_TABLES
from tools.compare import rows_of

from .conftest import SF_SMALL

from mailflow.plans.queries import QUERIES as LIBRARY

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_listed_rows_only():
    rows_only = set(LIBRARY) - set(ORACLE)
    assert rows_only == set()
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "id_email" in df.columns and "nome_arquivo" in df.columns


def test_mail_keys_are_unique(spark):
    df = QUERIES["capture_emails"](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) > 0
    assert len({r.id_email for r in rows}) == len(rows)
