"""How filters of a corpus interact: what each removes in every order of application.

A document is its set of failed filters. Which documents a filter removes depends only on the set of filters
applied before, so all orders are paths through the lattice of such sets: a document contributes to one edge
for each (already applied set, next filter), 80 for five filters, and the 600 steps of the 120 orders are
looked up among the aggregated edges.

Scale: texts stay where they are read; a document travels as its id and a 32-byte hash of its text, then as
counts. Copies are found by a pre-aggregated smallest id, so a text that a third of all rows share
is one row a task. Edges are made of counts by (part, failed filters, labels), not of documents. The 80 edges
and 600 steps are fixed tables.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: The filter that looks for copies.
COPY = 1 << LETTERS.index("E")
WORD = r"[^\x20\x09-\x0D]+"
#: Orders with a given filter behind a given set: those of the set times those of the rest.
ORDERS = {k: factorial(k) * factorial(len(LETTERS) - 1 - k) for k in range(len(LETTERS))}


def text_failures(text: F.Column, words: F.Column) -> F.Column:
    """The failed filters among A to D of a text and its words, as bits: too few words, repeated words, capitals, signs."""
    failed = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, failed, good, toxic, n): how many rows of a part fail just these filters (as bits) and have these labels."""
    text = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), text_failures(F.col("text"), F.col("words")).alias("failed"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    key = ["copy", "failed", "part", "good", "toxic"]
    marked = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # A row without an id counts as one with the largest.
    single = marked.groupBy("doc_id", *key).agg(F.count("*").alias("n")).withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    grouped = single.groupBy(*key).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by("n", "id").alias("n_first"))
    first = F.when(F.col("id") == F.min("id").over(Window.partitionBy("copy")), F.col("n_first")).otherwise(F.lit(0))
    split = grouped.withColumn("first", first).select("part", "good", "toxic", F.inline(F.array(F.struct("failed", F.col("first").alias("n")), F.struct(F.col("failed").bitwiseOR(COPY).alias("failed"), (F.col("n") - F.col("first")).alias("n")))))
    return split.where("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(counts: DataFrame) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, good_lost, toxic_lost, unique_fails, shapley), a row for each of a part's 80 edges."""
    size = len(LETTERS)
    pairs = [(s, i) for s in range(1 << size) for i in range(size) if not s >> i & 1]
    every = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(i).alias("filter"), F.lit(1 << i).alias("bit")) for s, i in pairs])
    met = counts.select("*", F.inline(every))
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).alias(name)
    summed = met.groupBy("part", "applied", "filter").agg(
        total(~fails & ~gone, "kept"), total(fails & ~gone, "removed"), total(fails & gone, "redundant"),
        total(fails & ~gone & F.col("good"), "good_lost"), total(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )
    orders = F.create_map(*[F.lit(x) for pair in ORDERS.items() for x in pair])[F.bit_count("applied")]
    of_filter = Window.partitionBy("part", "filter")
    last = F.bit_count("applied") == size - 1
    return summed.withColumns({"unique_fails": F.max(F.when(last, F.col("removed"))).over(of_filter), "shapley": F.sum(F.col("removed") * orders).over(of_filter)})


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, failed but removed before, and lost.

    A: under 200 words; B: under half of the words distinct; C: over a fiftieth capitals; D: a sign of markup;
    E: the text of a smaller id. Null texts are empty texts, a null part is "". A row without an id counts as
    one with the largest id, and has no labels; repeated rows of the smallest id aren't copies of each other.
    Of repeated labels, one that says so is enough. Other columns are ignored; an empty table gives no rows.
    A text of any length costs one task its words.
    """
    steps = [("".join(LETTERS[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(len(LETTERS))) for k in range(len(LETTERS))]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    found = edges(failures(docs, labels, part)).join(F.broadcast(paths), ["applied", "filter"])
    return found.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def oracle(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for ``audit``: each order walked by itself, to a document's first failed filter."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
f AS (SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
  FROM d),
c AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, count(*) AS n FROM f LEFT JOIN {labels} USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
walked AS (SELECT part, filter_order, fails, good, bad, n, list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN 9 ELSE strpos(filter_order, x) END)) AS out FROM c, o),
steps AS (SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS letter,
    coalesce(sum(n) FILTER (out IS NULL OR out > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (out = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (out < step AND contains(fails, filter_order[step])), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = filter_order[step]), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (out = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (out = step AND bad), 0)::BIGINT AS toxic_lost
  FROM walked, range(1, 6) AS r(step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM steps
"""
