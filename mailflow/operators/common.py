"""Shared plan helpers: optional predicates, ordered top-k, bounded joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest row count a side may have for us to broadcast it explicitly. Only
# used for sides whose size is bounded by construction (a top-k result); all
# other joins are left to AQE, which broadcasts at run time only when the
# measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
BROADCAST_MAX_ROWS = 100_000


# Rows of one task of ``spread``: their sorts and groups take some 250 MB.
SPREAD_ROWS = 500_000


def spread_count(df: DataFrame) -> int | None:
    """Partitions for ``spread`` of a large table; None where the session's setting will do."""
    n = -(-df.count() // SPREAD_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def spread(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """Rows by hash of ``key`` over ``n`` partitions, so that the memory of the tasks of joins and groups by
    that key does not grow with the table, as it does with a fixed number or one chosen by packed bytes."""
    return df if n is None else df.repartition(n, key)


def given(value) -> bool:
    """Parameter truthiness of the listing endpoints: None and '' mean 'no filter'."""
    return value is not None and value != ""


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """Add ``col == value`` only for parameters that were supplied."""
    for col, value in equals.items():
        if given(value):
            df = df.filter(F.col(col) == F.lit(value))
    return df


def on_date(df: DataFrame, ts: str, day) -> DataFrame:
    """Calendar-date equality; Catalyst turns it into a pushed range."""
    if given(day):
        df = df.filter(F.to_date(F.col(ts)) == F.to_date(F.lit(str(day))))
    return df


def in_date_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Inclusive calendar-date range, each end optional."""
    if given(start):
        df = df.filter(F.to_date(F.col(ts)) >= F.to_date(F.lit(str(start))))
    if given(end):
        df = df.filter(F.to_date(F.col(ts)) <= F.to_date(F.lit(str(end))))
    return df


def top_k(df: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """Ordered limit; planned as TakeOrderedAndProject (per-partition top-k,
    then a merge of at most k rows per partition). ``k=None`` sorts fully."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(int(k))


def materialize_page(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Compute a bounded page (a top-k result) once.

    The page feeds several joins (semi-join reductions and the final join);
    without this, each use would re-run the full scan and join that produced
    it. A reliable checkpoint to the shared checkpoint folder writes at most
    ``max_rows`` rows and cuts the lineage. Unbounded frames stay lazy.
    """
    if max_rows is None or max_rows > BROADCAST_MAX_ROWS:
        return df
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by ``max_rows``."""
    if max_rows is not None and max_rows <= BROADCAST_MAX_ROWS:
        return F.broadcast(df)
    return df


def restrict_to(big: DataFrame, keys: DataFrame, on: str, max_keys: int | None) -> DataFrame:
    """Semi-join reduction: keep rows of ``big`` whose ``on`` occurs in ``keys``.

    ``keys`` is a small, bounded side (e.g. the ids of a top-k page), so the
    big table is scanned once with a broadcast hash semi join and never
    shuffled. Without a bound the semi join is left to AQE.
    """
    k = keys.select(on).where(F.col(on).isNotNull())
    return big.join(bounded(k, max_keys), on, "left_semi")


def left_join_bounded(small: DataFrame, big: DataFrame, left_on: str, right_on: str,
                      max_rows: int | None) -> DataFrame:
    """``small`` LEFT JOIN ``big`` where ``small`` has at most ``max_rows`` rows.

    Without a bound it is one plain left join. A left outer join cannot
    broadcast its left side, so with a bound it is an inner join with the
    broadcast page, in which ``big`` stays in its scan tasks (the rows of a hot
    key are not brought together), and the page's rows without a match.
    ``small`` is read three times: it should be materialised.
    """
    if max_rows is None or max_rows > BROADCAST_MAX_ROWS:
        return small.join(big, small[left_on] == big[right_on], "left").drop(big[right_on])
    inner = big.join(F.broadcast(small), F.col(right_on) == F.col(left_on), "inner")
    found = restrict_to(big.select(right_on), small.select(F.col(left_on).alias(right_on)), right_on, max_rows).distinct()
    alone = small.join(found, F.col(left_on) == F.col(right_on), "left_anti")
    cols = [*small.columns, *[c for c in big.columns if c != right_on]]
    return inner.select(*cols).unionByName(alone, allowMissingColumns=True)


def desc_nf(c) -> Column:
    """DESC with NULLs first -- the order of the source database."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def asc_nf(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_first()
