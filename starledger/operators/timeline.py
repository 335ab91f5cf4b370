"""Integration time over months and nights."""

from __future__ import annotations

import datetime as dt
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import night
from ..functions.text import contains
from ..schema import IMAGE_KINDS, IMAGE_TYPES


def plotted(images: DataFrame, use_intermediate: bool = False, library_id: int | None = None, camera: str | None = None, telescope: str | None = None) -> DataFrame:
    """Light frames of the plotted kind, of one library, camera and telescope where given (all must hold)."""
    df = images.where((F.col("type") == IMAGE_TYPES["Light"]) & (F.col("kind") == IMAGE_KINDS["Intermediate" if use_intermediate else "Raw"]))
    if library_id is not None:
        df = df.where(F.col("library_id") == library_id)
    if camera:
        df = df.where(contains("camera_name", camera))
    if telescope:
        df = df.where(contains("telescope_name", telescope))
    return df


def _observed_between(low: dt.date, high: dt.date) -> Column:
    """Whether an image was taken from noon of ``low`` to noon of ``high``, on time columns themselves, so that files and row groups of other times are not read."""
    a, b = (F.lit(f"{d.isoformat()} 12:00:00").cast("timestamp_ntz") for d in (low, high))
    local, utc = F.col("observation_timestamp_local"), F.col("observation_timestamp_utc")
    return ((local >= a) & (local < b)) | (local.isNull() & (utc >= a) & (utc < b))


def _by_bucket(images: DataFrame, fmt: str, start: str, end: str, low: dt.date, high: dt.date, **selection) -> DataFrame:
    """The bucket and hours of each bucket from start to end, which lie between two noons; hours are null where no exposure is known."""
    bucket = night(fmt)
    df = plotted(images, **selection).where(_observed_between(low, high)).withColumn("bucket", bucket).where(F.col("bucket").between(start, end))
    return df.groupBy("bucket").agg((F.sum("exposure") / 3600).alias("hours")).orderBy("bucket")


def integration_by_month(images: DataFrame, start: dt.date, end: dt.date, **selection) -> DataFrame:
    """(bucket 'yyyy-MM', hours) of the months from ``start``'s to ``end``'s, in order; nights count to the day they begin."""
    after = dt.date(end.year + end.month // 12, end.month % 12 + 1, 1)
    return _by_bucket(images, "yyyy-MM", f"{start:%Y-%m}", f"{end:%Y-%m}", start.replace(day=1), after, **selection)


def integration_by_night(images: DataFrame, start: dt.date, end: dt.date, **selection) -> DataFrame:
    """(bucket 'yyyy-MM-dd', hours) of the nights from ``start`` to ``end``, in order."""
    return _by_bucket(images, "yyyy-MM-dd", f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}", start, end + dt.timedelta(1), **selection)


def night_grid(images: DataFrame, start: dt.date, end: dt.date, **selection) -> DataFrame:
    """(week, day, date, hours): seven days by whole weeks from the earlier date on, 0 where nothing was taken.

    There are ``ceil(days / 7)`` weeks between the dates, one at least, so the last date has no cell
    where it lies a whole number of weeks after the first. Nights are taken from start to end as given.
    """
    first, last = min(start, end), max(start, end)
    weeks = max(1, ceil((last - first).days / 7))
    cells = images.sparkSession.range(7 * weeks).select((F.col("id") / 7).cast("int").alias("week"), (F.col("id") % 7).cast("int").alias("day"), F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    nights = integration_by_night(images, start, end, **selection)
    return cells.join(nights, F.date_format("date", "yyyy-MM-dd") == F.col("bucket"), "left").select("week", "day", "date", F.coalesce("hours", F.lit(0.0)).alias("hours")).orderBy("week", "day")


def default_range(now: dt.date, plot: str) -> tuple[dt.date, dt.date]:
    """The dates a plot begins with: a year back for months and nights, three months for objects."""
    return (_months_back(now, 3 if plot == "objects" else 12), now)


def preset(now: dt.date, months: int) -> tuple[dt.date, dt.date]:
    """6, 12 or 24 months back."""
    return (_months_back(now, months), now)


def _months_back(day: dt.date, months: int) -> dt.date:
    month = day.year * 12 + day.month - 1 - months
    year, month = divmod(month, 12)
    for d in range(day.day, 27, -1):
        try:
            return dt.date(year, month + 1, d)
        except ValueError:
            pass
    return dt.date(year, month + 1, min(day.day, 28))
