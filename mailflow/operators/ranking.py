"""Position of each row inside its group, safe for hot groups.

``row_number() OVER (PARTITION BY g ORDER BY ...)`` sends a whole group to one
task; a group holding a third of the table would then be sorted by a single
task. ``rank_within`` gives the same numbers without that:

1. range-partition and sort by ``(g, order...)`` -- the range partitioner
   samples the full sort key, so a hot group is spread over many partitions;
2. number rows inside each partition (``monotonically_increasing_id`` follows
   the sorted order) and cut the lineage with a reliable checkpoint;
3. per-partition row counts (one row per partition -- a proven bound, so it
   is broadcast) turn local numbers into global positions;
4. the first global position per group is a plain aggregate (map-side
   combined), joined back on the group key (AQE splits a skewed side).

position = global index - first global index of the group + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LOCAL_BITS = 33  # record-number bits of monotonically_increasing_id


def rank_within(df: DataFrame, group: str, order: list[Column], name: str = "posicao",
                partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(group).asc_nulls_first(), *order]
    ordered = (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mono", F.monotonically_increasing_id()))
    ordered = ordered.checkpoint(eager=True)

    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), LOCAL_BITS)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum runs in a single small task.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    indexed = ordered.join(F.broadcast(offsets), "_pid").withColumn("_gi", F.col("_off") + local)
    firsts = indexed.groupBy(group).agg(F.min("_gi").alias("_first")) \
                    .withColumnRenamed(group, "_g")
    # Null-safe: rows with a NULL group key form one group, as in a window.
    out = indexed.join(firsts, indexed[group].eqNullSafe(firsts["_g"]), "inner")
    out = out.withColumn(name, F.col("_gi") - F.col("_first") + 1)
    return out.drop("_pid", "_mono", "_off", "_gi", "_first", "_g")
