"""Mixing sources to target weights by weighted sampling with exponential keys.

Each document draws the key ``-ln(u) / q``: ``u`` is a uniform number made from
its id and text, ``q`` its quality weight. Sorting a source by that key is
weighted sampling without replacement. A source's budget is spent on complete
epochs first; what is left of it goes to the documents with the smallest keys,
found by prefix sums.

No task sees a whole source. The logarithm of an exponential key has a density of
at most 1 / e, whatever the weights and however they are mixed, so cutting it into
equal steps gives ordered buckets of ``bucket_rows`` rows at most, on average. Sums
of buckets give the running total before each bucket, and only rows within one
bucket are sorted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, word_count

#: 52 bits of a digest, as a number in (0, 1).
UNIT_HEX, UNIT_SCALE = 13, float(2**52)
#: Sources up to which their budgets are sent to every task.
SENT_SOURCES = 100_000


def quality_weight(text: Column) -> Column:
    """Share of letters among a text's characters, moved to 0.25 .. 1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(F.length(text) > 0, F.lit(0.25) + F.lit(0.75) * letters / F.length(text)).otherwise(F.lit(0.25))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, UNIT_HEX), 16, 10).cast("double") + 0.5) / F.lit(UNIT_SCALE)
    return -F.log(unit) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """Budgets for rows ``skey, source, source_size, n_docs``: one row per source.

    The sources share the whole by weight; one that would pass ``limit`` times
    its own size stops there and its excess goes to the others by weight. Sorted
    by size over weight, the stopped sources are a prefix, so one ordered pass
    over the per-source rows finds the common level of the rest: the level before
    the first source that stays under its cap, which is the highest such level.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level", level).withColumn("common", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    return levelled.select("skey", "source_size", "n_docs", F.least(F.col("cap"), F.col("common") * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    seed: str = "mix",
    bucket_rows: int = 2000,
) -> DataFrame:
    """One row per document of ``docs``: how many of its words the mix takes.

    Sources by code point (null last) weigh ``weights`` in turn and share all
    words. Returns doc_id, source, size, source_size, target, epochs (times the
    document enters the mix), taken (= epochs * size). Empty and null texts have
    size 0 and take 0; equal rows are sampled as separate rows of equal key, in
    which ties break by size; texts are counted whole, other columns are left out; an empty table gives no rows. The same rows give
    the same mix on every run.
    """
    key = sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed)
    base = cut(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            word_count(F.col("text")).alias("size"),
            key.alias("key"),
        )
    )
    sizes = cut(base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    targets = source_targets(sizes, weights, limit)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("full", full).withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0)))
    steps = F.greatest(F.lit(1.0), F.col("n_docs") / F.lit(math.e * bucket_rows))
    bucket = F.floor(F.log("key") * steps).cast("long")
    rows = base.join(F.broadcast(budgets) if sizes.count() <= SENT_SOURCES else budgets, "skey").withColumn("bucket", bucket)
    spent = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spent = spent.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(spent, ["skey", "bucket"]).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # the document at the edge goes in if that lands nearer to the budget
    extra = (F.col("before") + F.col("size") / F.lit(2.0) <= F.col("rest")).cast("long")
    epochs = F.least(F.col("full") + extra, F.lit(limit))
    return placed.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))


#: DuckDB SQL for the rows of :func:`mix_sources` over the table ``{docs}``.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0
              THEN 0.25::DOUBLE + 0.75::DOUBLE * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / length(text)
              ELSE 0.25::DOUBLE END AS q,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM {docs}),
k AS (SELECT doc_id, source, size, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(CASE WHEN cap / weight >= level THEN level END) OVER () * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, greatest(b.target - b.epochs * b.source_size, 0) AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (least(epochs + CASE WHEN earlier + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM r
"""
