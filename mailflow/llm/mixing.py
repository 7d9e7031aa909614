"""Mixing sources to target weights by Efraimidis-Spirakis sampling, native Spark only.

Every source gets a target of words: ``share`` of all sizes dealt by the
sources' weights, never over ``max_epochs`` times a source's own size; the
excess goes to the others by weight until none is above (the closed form of
that water filling over the sources in order of size per weight). A source
first takes its complete epochs; the rest of its target is filled by documents
in the order of exponential keys -ln(u)/quality, up to the prefix sum that
reaches it. The document at the border is taken if that brings the total
nearer to the target, so a source misses its target by half a document at most.

The order is needed only near the border: documents are dealt into
``buckets`` key ranges per source, whole ranges are taken or left by their
sums, and only the documents of the border range are sorted, so a hot source
is no single task's work. ``u`` comes from md5 of doc_id and a seed, so reruns
agree.

Quality: the share of letters among the characters that are no white space
(square root weight), at least 0.05; a document without words weighs 0.05.
Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in order; a source of size 0 has target 0; an empty
table gives no rows; equal keys are ordered by doc_id, then size, then the
row's content; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, sized_broadcast, stored

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Letters among the characters that are no white space, 0.05 to 1."""
    dense = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(F.greatest(1 - odd / F.nullif(dense, F.lit(0)), F.lit(0.05)), F.lit(0.05))


def targets(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``(source, source_size, weight)`` -> with ``target`` words per source.

    One row per source; the windows run over that list, not over documents.
    """
    up = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    everyone = Window.partitionBy()
    x = (sizes.withColumn("cap", F.col("source_size") * max_epochs)
         .withColumn("k", F.row_number().over(up))
         .withColumn("caps_before", F.coalesce(
             F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("rate", (F.sum("source_size").over(everyone) * share - F.col("caps_before")) / F.col("weight_left")))
    first = F.min(F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct("k", "rate"))).over(everyone)
    return (x.withColumn("level", first)
            .withColumn("target", F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), F.col("cap"))
                        .otherwise(F.col("level.rate") * F.col("weight")))
            .select("n", "source", "source_size", "weight", F.col("target").cast("double").alias("target")))


def mix(docs: DataFrame, size: str = "size", weight: str = "quality", share: float = 1.5,
        max_epochs: float = 2.0, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """Adds ``source_size, target, epochs, extra, taken`` to ``docs(doc_id, source, size, quality, ...)``.

    ``epochs`` complete passes take every document; ``extra`` is 1 where the
    fractional pass takes it too; ``taken`` = size * (epochs + extra).
    """
    digits = F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = (docs.withColumn("key", -F.log(u) / F.col(weight))
             .withColumn("bucket", F.floor(F.col("key") / (1 + F.col("key")) * buckets).cast("int")))
    # At most ``buckets`` rows per source, whatever the number of documents.
    per = cut(keyed.groupBy("source", "bucket").agg(F.sum(size).alias("words")))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    listed = (per.groupBy("source").agg(F.sum("words").alias("source_size"))
              .withColumn("n", F.row_number().over(order) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("n") % len(WEIGHTS) + 1).cast("int"))))
    plan = cut(targets(listed, share, max_epochs)
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
               .withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
               .select(F.col("source").alias("src"), "source_size", "target", "epochs", "rest"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(per.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
                 .join(plan, F.col("source").eqNullSafe(F.col("src")))
                 .withColumn("side", F.when(F.col("before") + F.col("words") <= F.col("rest"), 1)
                             .when(F.col("before") >= F.col("rest"), -1).otherwise(0))
                 .select("src", F.col("bucket").alias("range"), "source_size", "target", "epochs", "rest", "before", "side"))
    placed = keyed.join(sized_broadcast(ranges, 200_000),
                        F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("range")))
    clear = placed.where("side <> 0").withColumn("extra", F.when(F.col("side") > 0, 1).otherwise(0))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", size, F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    border = (placed.where("side = 0")
              .withColumn("at", F.col("before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
              .withColumn("extra", F.when(F.col("at") + F.col(size) / 2 <= F.col("rest"), 1).otherwise(0)).drop("at"))
    return (clear.unionByName(border).withColumn("taken", F.col(size) * (F.col("epochs") + F.col("extra")))
            .drop("src", "range", "bucket", "key", "before", "rest", "side"))


def op7(documents: DataFrame) -> DataFrame:
    """Contract query over every document."""
    docs = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                   quality(F.col("text")).alias("quality")), "mixing")
    return mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


SQL = r"""
WITH docs AS (
 SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  coalesce(greatest(1 - length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g'))
                        / nullif(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0), 0.05), 0.05) AS quality
 FROM documents),
keyed AS (
 SELECT *, -ln((CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), '7')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
               / 4503599627370496.0::DOUBLE) / quality AS key FROM docs),
listed AS (
 SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][n % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM listed),
filled AS (
 SELECT *, row_number() OVER w AS k,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
 FROM weighed WINDOW w AS (ORDER BY cap / weight, n)),
levels AS (SELECT min(k) AS k FROM filled WHERE cap > rate * weight),
targets AS (
 SELECT f.source, f.source_size,
  CASE WHEN l.k IS NULL OR f.k < l.k THEN f.cap ELSE (SELECT rate FROM filled g WHERE g.k = l.k) * f.weight END AS target
 FROM filled f, levels l),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (
 SELECT k.*, p.source_size, p.target, p.epochs, greatest(p.target - p.epochs * p.source_size, 0) AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
 FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
 CAST(size * (epochs + CASE WHEN upto + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""
