"""Images whose headers are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import IMAGE_TYPES


def duplicates(images: DataFrame, library_id: int, lights_only: bool = False) -> DataFrame:
    """Images of any library whose hash more than one image of ``library_id`` has, with ``group_name``.

    Hashes compare without ASCII case. Groups are numbered in hash order. The repeated hashes are found
    by a partly pre-aggregated count and joined back, so no window holds a group of images; only the
    hashes, one row each, are numbered.
    """
    key = F.lower("header_hash")
    repeated = images.where((F.col("library_id") == library_id) & F.col("header_hash").isNotNull()).groupBy(key.alias("_hash")).agg(F.count("*").alias("n")).where("n > 1").select("_hash")
    numbered = _numbered(repeated)
    found = images.join(numbered, key == F.col("_hash"))
    if lights_only:
        found = found.where(F.col("type") == IMAGE_TYPES["Light"])
    return found.select(*images.columns, F.concat(F.lit("Group "), F.col("_number").cast("string")).alias("group_name"))


def _numbered(hashes: DataFrame) -> DataFrame:
    """Hashes numbered from 1 in order, by their first two digits: counts of the 256 classes are summed before, and each class is ranked apart."""
    classed = hashes.withColumn("_class", F.substring("_hash", 1, 2))
    sizes = classed.groupBy("_class").agg(F.count("*").alias("_size"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._class") < F.col("a._class"), "left").groupBy(F.col("a._class").alias("_class")).agg(F.coalesce(F.sum("b._size"), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_hash"))
    return classed.withColumn("_rank", rank).join(F.broadcast(before), "_class").select("_hash", (F.col("_before") + F.col("_rank")).alias("_number"))


def scrub_missing(images: DataFrame, shown: DataFrame, existing: DataFrame) -> DataFrame:
    """``images`` without those of ``shown`` (id, path) whose path isn't in ``existing`` (path)."""
    gone = shown.join(existing.select("path").distinct(), "path", "left_anti").select(F.col("id").alias("_gone"))
    return images.join(gone, F.col("id") == F.col("_gone"), "left_anti")
