"""Mixing sources to target weights by weighted sampling without replacement.

Each source's target is its weight's share of all words, at most ``epochs`` times what it holds; what is
above that is shared by weight among the others. A source gives its documents whole as often as the target
allows (complete epochs). The rest of the target goes by Efraimidis-Spirakis order: a document's key is an
exponential variable over its quality weight, small keys first, and sizes are summed up to the rest; the
document that crosses it gives the words that fit.

Scale: only built-in functions. Texts stay where they are read; a row travels as id, source, size and key. Keys
are split into strides of the unit interval that ``exp(-key)`` covers, and sums by (source, stride) show in which stride
a source's rest ends. Strides below are taken, strides above aren't; only the rows of that one stride are
sorted, so a hot source costs a task about one of ``STRIDES`` of it. Targets come from a range-partitioned
order of the sources; one row a source is broadcast up to a counted number, else joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, ranked

#: Parts of each source's order. A source's running sum by stride is one window.
STRIDES = 4096
#: Sources (about 60 bytes each) that may be broadcast.
BROADCAST_SOURCES = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[F.Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with sums of its long columns over this and all earlier rows of a total order, over ranges of that order."""
    placed = ranked(df, order, "_place").withColumn("_range", F.floor(F.col("_place") / 4096))
    within = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    each = placed.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = each.select("_range", *[F.coalesce(F.sum(n).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}") for n in sums])
    inner = placed.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    return inner.join(before, "_range").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", "_place", *[f"_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(source, source_size) with the ``target`` of each source: weights go by code point order, null last, and repeat.

    Sources are held at ``epochs`` times their size in the order of that bound over their weight, as long as
    the others' shares reach it; what is left is shared by weight. If all are held, or all are empty, nothing is left.
    """
    place = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    bounds = place.select("source", "source_size", "place", share.alias("weight"), (epochs * F.col("source_size")).alias("bound"))
    held = checkpointed(running(bounds, [(F.col("bound") / F.col("weight")).asc(), F.col("place").asc()], {"sum_bound": "bound", "sum_weight": "weight"}))
    total, all_weights = held.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    full = F.col("sum_bound") + F.col("bound") / F.col("weight") * (all_weights - F.col("sum_weight")) <= total
    used, rest = held.agg(F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
    return held.select("source", "source_size", F.when(full, F.col("bound").cast("double")).otherwise(F.col("weight") * F.lit(float(total - used)) / F.lit(float(rest or 1))).alias("target"))


def quality_weights(labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """(doc_id, weight) of labelled documents; of repeated labels the best counts."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") >= 1, F.lit(good)).otherwise(F.lit(poor)).alias("weight"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """For each row of ``docs``: doc_id, size, source_size, target (its source's) and ``taken``, the words that the mix takes of it.

    ``quality`` has (doc_id, weight above 0); documents without one weigh 1. Null and empty texts have size 0
    and give nothing. Null sources are one source, after all others. Rows without an id have their text's hash for it; equal
    keys go by id, then by text. Repeated rows each count. Other columns are ignored. An empty table gives no rows.
    A text of any length costs one task a pass over it.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    if quality is not None:
        rows = rows.join(quality.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    seen = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string")))), 256)
    uniform = (F.conv(F.substring(seen, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(uniform) / F.coalesce("weight", F.lit(1.0)))
    rows = checkpointed(rows.select("doc_id", "source", "size", "tie", "key", F.least(F.lit(STRIDES - 1), F.floor(STRIDES * (1 - F.exp(-F.col("key"))))).cast("int").alias("stride")))

    strides = checkpointed(rows.groupBy("source", "stride").agg(F.sum("size").alias("held")))
    goal = targets(strides.groupBy("source").agg(F.sum("held").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("stride").rowsBetween(Window.unboundedPreceding, 0)
    ends = strides.withColumn("upto", F.sum("held").over(upto)).withColumnRenamed("source", "_source")
    crossed = goal.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("upto") > F.col("rest")), "left").groupBy("source", "source_size", "target", "whole", "rest").agg(F.min(F.struct("stride", (F.col("rest") - F.col("upto") + F.col("held")).alias("left"))).alias("end"))
    plan = checkpointed(crossed.select(F.col("source").alias("_source"), "source_size", "target", "whole", F.coalesce("end.stride", F.lit(-1)).alias("last"), F.coalesce("end.left", F.lit(0)).alias("left")))
    placed = rows.join(broadcast_if_small(plan, plan.count(), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = placed.where("stride = last").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - before)))
    clear = placed.where("stride <> last").withColumn("part", F.when(F.col("stride") < F.col("last"), F.col("size")).otherwise(F.lit(0)))
    return split.unionByName(clear).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def oracle(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for ``mix`` with quality weights and its defaults: one running sum over each source."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || sha256('7:' || doc_id)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496) / CASE WHEN quality >= 1 THEN 2.0::DOUBLE WHEN quality IS NOT NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM {docs} LEFT JOIN {labels} USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
b AS (SELECT *, 3 * source_size AS bound, sum(3 * source_size) OVER o AS sum_bound, sum(w) OVER () - sum(w) OVER o AS rest_w, sum(source_size) OVER () AS total FROM s
  WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum_bound + bound::DOUBLE / w * rest_w <= total AS held FROM b),
g AS (SELECT source, source_size, CASE WHEN held THEN bound::DOUBLE ELSE w * (total - coalesce(sum(bound) FILTER (held) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT held) OVER ())::DOUBLE END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
r AS (SELECT doc_id, size, source_size, target, whole, floor(target)::BIGINT - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
