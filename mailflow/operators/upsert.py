"""Keyed upserts, update-only merges and last-wins reduction.

Plain parquet has no MERGE, so an upsert is expressed functionally: the new
table = target rows updated from the source + source rows whose key is new.
The caller writes the result to a new location (``sinks.tables``); never read
and overwrite one path in the same job.

Scale: one join on the key reads the target and the source once each; the
source is reduced to one row per key before it, partly map-side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def first_per_key(df: DataFrame, keys: str | list[str], order: Iterable) -> DataFrame:
    """The row with the smallest ``order`` per key.

    An aggregate (``min`` over a struct of order columns and payload), so it
    combines map-side: a key holding a third of all rows is reduced inside
    every input task before one row per task crosses the shuffle.
    """
    return _extreme_per_key(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: str | list[str], order: Iterable) -> DataFrame:
    """The row with the largest ``order`` per key (last write wins)."""
    return _extreme_per_key(df, keys, order, F.max)


def _extreme_per_key(df: DataFrame, keys, order, agg) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = list(order)
    order_names = [f"_o{i}" for i in range(len(order))]
    payload = [c for c in df.columns if c not in keys]
    packed = F.struct(*[c.alias(n) for c, n in zip(_cols(order), order_names)],
                      F.struct(*payload).alias("_row"))
    reduced = df.groupBy(*keys).agg(agg(packed).alias("_best"))
    return reduced.select(*keys, *[F.col("_best._row")[c].alias(c) for c in payload])


def upsert(target: DataFrame, source: DataFrame, key: str, update_cols: list[str],
           new_key: Column | None = None, key_col: str | None = None,
           insert: bool = True, insert_only_when: Column | None = None) -> DataFrame:
    """Insert-or-update ``source`` into ``target`` on ``key``.

    * Matched rows take every column in ``update_cols`` from the source --
      including NULLs (a matched new NULL overwrites; never ``coalesce``).
      All other columns keep the target's values.
    * Unmatched source rows are inserted (``insert=False``: update-only);
      ``insert_only_when`` limits which source rows may insert. Columns not
      given by the source are NULL; ``key_col``/``new_key`` generate a
      surrogate key for inserted rows.
    * The source must hold one row per key (see ``last_per_key``); a repeated
      key fails the job.

    One join reads either side once: full outer, or left for update-only.
    """
    src = source.select(key, *update_cols, *( [insert_only_when.alias("_may_insert")]
                                              if insert_only_when is not None else []))
    one = src.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                               F.first(F.struct(*[c for c in src.columns if c != key])).alias("_new"))
    old = target.select(F.struct(*target.columns).alias("_old"), F.col(key).alias("_tkey"))
    both = old.join(one, old["_tkey"] == one[key], "full_outer" if insert else "left")
    both = both.select("_old", "_n", key, *[F.col("_new")[c].alias(c) for c in src.columns if c != key])
    found, hit = F.col("_old").isNotNull(), F.col("_n").isNotNull()
    wanted = found if insert_only_when is None else found | F.coalesce(F.col("_may_insert"), F.lit(False))
    if insert_only_when is None and insert:
        wanted = F.lit(True)
    repeated = F.raise_error(F.concat(F.lit(f"upsert: more than one source row for {key} "), F.col(key).cast("string")))
    both = both.where(F.when(F.col("_n") > 1, repeated.cast("boolean")).otherwise(wanted))

    def value(c: str) -> Column:
        was = F.col("_old")[c]
        if c in update_cols:
            return F.when(hit, F.col(c)).otherwise(was)
        if c == key:
            return F.when(found, was).otherwise(F.col(key))
        if c == key_col and new_key is not None:
            return F.when(found, was).otherwise(new_key)
        return was

    return both.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def append_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` whose ``key`` is not yet in ``target`` (idempotent append).

    The target's keys are de-duplicated first (map-side combined), so a hot
    key cannot pile up in one join partition."""
    return rows.join(target.select(key).distinct(), key, "left_anti")


def conform_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])
