"""Site-relative line deduplication.

A line of a host is boilerplate if the share of the host's pages that contain it exceeds a ratio.
Pages of equal text count once, so copies of one page don't turn its lines into boilerplate; with
``near_copy_groups`` each group of near copies counts once too. Lines
are compared without surrounding spaces; blank lines are never counted and never dropped.

Scale: lines go through the shuffle as 64-bit hashes, counted partly before it; a hot host is split
over its lines. A host has at most (lines a page / ratio) boilerplate lines. They are broadcast up to
a counted number, else joined by host, where adaptive execution splits a hot host's pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, fresh
from .jaccard import near_components

#: Boilerplate lines (8 bytes each) that may be broadcast.
BROADCAST_LINES = 1 << 20


#: Pages in groups of near copies (16 bytes each) that may be broadcast.
BROADCAST_PAGES = 1 << 20


def near_copy_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(page, group): the group of near copies of each text that has others, by the exact n-gram Jaccard join; texts go by their hash."""
    found = near_components(docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")))
    return checkpointed(found.where("doc_id <> component_id").select(F.col("doc_id").alias("page"), F.col("component_id").alias("group")).distinct())


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 5, groups: DataFrame | None = None) -> DataFrame:
    """(host, lines): for each host with boilerplate, the hashes of its boilerplate lines.

    ``least_pages`` distinct pages must have a line, else a host of few pages would lose all its text.
    Null hosts are one host; null texts are no pages. The pages of one of ``groups`` are one page, with
    the lines of all.
    """
    pages = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x))).alias("lines"))
    if groups is not None:
        pages = pages.join(broadcast_if_small(groups, groups.count(), BROADCAST_PAGES), "page", "left").select("host", F.coalesce("group", "page").alias("page"), "lines")
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    counts = pages.select("host", "page", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(totals, "host").where(F.col("pages") > ratio * F.col("total")).groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 5, groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text`` freed of its host's boilerplate lines, and two columns more: ``n_lines`` (not blank) and ``n_dropped``.

    Every row stays, with all its columns; an input column of those two names is replaced. A text that
    loses all its lines becomes empty; null stays null, with no lines.
    """
    found = checkpointed(boilerplate_lines(docs, host, text, ratio, least_pages, groups))
    count = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    site, known, all_lines, hit, kept = fresh(docs, "_host", "_boilerplate", "_lines", "_hit", "_kept")
    side = broadcast_if_small(found.select(F.col("host").alias(site), F.col("lines").alias(known)), count, BROADCAST_LINES)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    key = lambda x: F.xxhash64(F.trim(x))
    full = lambda c: F.size(F.filter(c, lambda x: F.trim(x) != ""))
    return (
        docs.select(*names)
        .withColumn(all_lines, F.split(text, "\n"))
        .join(side, F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col(site), "left")
        .withColumn(hit, F.coalesce(F.array_intersect(F.transform(all_lines, lambda x: key(x)), F.col(known)), F.array().cast("array<bigint>")))
        .withColumn(kept, F.when(F.size(hit) == 0, F.col(all_lines)).otherwise(F.filter(all_lines, lambda x: (F.trim(x) == "") | ~F.array_contains(hit, key(x)))))
        .select(
            *[F.when(F.size(hit) == 0, F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in names],
            F.greatest(F.lit(0), F.coalesce(full(all_lines), F.lit(0))).cast("long").alias("n_lines"),
            F.greatest(F.lit(0), F.coalesce(full(all_lines) - full(kept), F.lit(0))).cast("long").alias("n_dropped"),
        )
    )


def oracle(table: str = "documents", ratio: float = 0.1, least_pages: int = 5) -> str:
    """DuckDB SQL for doc_id, source, text, n_lines, n_dropped of ``drop_boilerplate`` without groups."""
    return f"""
WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS ls FROM {table}),
p AS (SELECT DISTINCT host, text FROM d WHERE text IS NOT NULL),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT DISTINCT host, text, trim(line, ' ') AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line, ' ') <> ''),
b AS (SELECT host, list(line) AS lines FROM (SELECT l.host, line FROM l JOIN t ON l.host = t.host GROUP BY l.host, line, total HAVING count(*) >= {least_pages} AND count(*) > {ratio} * total) GROUP BY host),
k AS (SELECT doc_id, source, text, ls, CASE WHEN lines IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(lines, trim(x, ' '))) END AS kept FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(list_filter(ls, lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""
