"""Summaries of images that follow from changes: sums and counts by key, kept by adding what comes and taking off what goes.

A rollup is a table of keys, a number of rows and an exact sum; a change of the catalogue is the rows removed
and the rows added (an edit is both). What a change costs follows its rows and the rollup's, not the catalogue's.
Seconds are decimals, so that taking off gives back just what was there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import night
from ..functions.text import contains_pattern, nocase, nocase_text
from .names import INDEXED

#: Exact seconds: what doubles of exposures and their sums keep.
SECONDS = "decimal(38, 12)"
INTEGRATION = ["library_id", "night", "type", "kind", "filter_name", "object_name", "camera_name", "telescope_name"]
#: Columns whose values are suggested.
SUGGESTED = ("object_name", "camera_name", "filter_name", "filter_wheel_name", "focuser_name", "rotator_name", "telescope_name")


def integration_rows(images: DataFrame) -> DataFrame:
    """(keys, n, known, seconds) of each image: one row, its exposure if it is known."""
    return images.withColumn("night", night("yyyy-MM-dd")).select(*INTEGRATION, F.lit(1).cast("long").alias("n"), F.col("exposure").isNotNull().cast("long").alias("known"), F.coalesce("exposure", F.lit(0.0)).cast(SECONDS).alias("seconds"))


def _names(columns: Iterable[str]) -> Column:
    """(column, value) of an image's names that are known."""
    return F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]), lambda x: x["value"].isNotNull())


def name_rows(images: DataFrame) -> DataFrame:
    """(column, key, value, n) of each name of an image that can be suggested; ``key`` is the folded value."""
    names = F.filter(_names(SUGGESTED), lambda x: x["value"] != "")
    return images.select(F.inline(names)).select("column", F.lower("value").alias("key"), "value", F.lit(1).cast("long").alias("n"))


def library_name_rows(images: DataFrame) -> DataFrame:
    """(library_id, column, key, value, n) of each name of an image, blank ones too, and one of column '' for the image itself."""
    own = F.array(F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("value")))
    return images.select("library_id", F.inline(F.concat(own, _names(INDEXED)))).select("library_id", "column", F.lower("value").alias("key"), "value", F.lit(1).cast("long").alias("n"))


def summed(rows: DataFrame) -> DataFrame:
    """Rows of equal keys as one; those that no image is left of go."""
    sums = [c for c in ("n", "known", "seconds") if c in rows.columns]
    kinds = dict(rows.dtypes)
    out = rows.groupBy(*[c for c in rows.columns if c not in sums]).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])
    return out.where("n <> 0").select(*rows.columns)


def changed(rollup: DataFrame, rows, removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """The rollup after images went and came; ``rows`` is what made it (``integration_rows`` or ``name_rows``)."""
    for images, sign in ((removed, -1), (added, 1)):
        if images is not None:
            made = rows(images)
            rollup = rollup.unionByName(made.select(*[(F.col(c) * sign).cast(kind).alias(c) if c in ("n", "known", "seconds") else F.col(c) for c, kind in made.dtypes]))
    return summed(rollup)


def _plotted(rollup: DataFrame, kind: int, start: str, end: str, bucket) -> DataFrame:
    lights = rollup.where((F.col("type") == 1) & (F.col("kind") == kind)).withColumn("bucket", bucket).where(F.col("bucket").between(start, end))
    sums = lights.groupBy("bucket").agg(F.sum("known").alias("known"), F.sum("seconds").alias("seconds"))
    return sums.select("bucket", F.when(F.col("known") > 0, F.col("seconds").cast("double") / 3600).alias("hours")).orderBy("bucket")


def integration_by_night(rollup: DataFrame, start: dt.date, end: dt.date, kind: int = 1) -> DataFrame:
    """(bucket, hours) of the nights from ``start`` to ``end``; hours are null where no exposure is known."""
    return _plotted(rollup, kind, f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}", F.col("night"))


def integration_by_month(rollup: DataFrame, start: dt.date, end: dt.date, kind: int = 1) -> DataFrame:
    """(bucket, hours) of the months from ``start``'s to ``end``'s."""
    return _plotted(rollup, kind, f"{start:%Y-%m}", f"{end:%Y-%m}", F.substring("night", 1, 7))


def integration_by_filter(rollup: DataFrame) -> DataFrame:
    """(filter, count, seconds) of light frames; most seconds first."""
    sums = rollup.where("type = 1").groupBy("filter_name").agg(F.sum("n").alias("count"), F.sum("seconds").cast("double").alias("seconds"))
    return sums.select(F.coalesce("filter_name", F.lit("None")).alias("filter"), "count", "seconds").orderBy(F.desc("seconds"), "filter")


def library_counts(rollup: DataFrame) -> DataFrame:
    """(library_id, files)."""
    return rollup.groupBy("library_id").agg(F.sum("n").alias("files"))


def suggestions(names: DataFrame, columns: list[str], text: str | None, most: int = 25) -> DataFrame:
    """From a rollup of names: up to ``most`` values of some columns that contain the text, once without case, in order; blank text gives none."""
    if not text or not text.strip():
        return names.limit(0).select("value")
    found = names.where(F.col("column").isin(*columns) & nocase("value").like(contains_pattern(text)))
    return found.groupBy("key").agg(F.min("value").alias("value")).orderBy("key").limit(most).select("value")


def starting_with(names: DataFrame, column: str, prefix: str, most: int = 25) -> DataFrame:
    """Up to ``most`` values of a column that begin with the text: a range of keys, which a table sorted by key reads alone."""
    return names.where((F.col("column") == column) & F.col("key").startswith(nocase_text(prefix))).groupBy("key").agg(F.min("value").alias("value")).orderBy("key").limit(most).select("value")
