"""Header hashes of a catalogue as a bucketed table, for joins that don't move the catalogue.

The table has a few narrow columns of each image, in buckets by folded hash and sorted within them. Scanned files
are dealt to the same buckets and merged in; counts of equal hashes need no exchange at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nocase
from .ingest import unique_files


@dataclass
class HashTable:
    """``name`` of a table of the session's catalogue; more buckets for more images (a bucket is read by one task)."""

    spark: SparkSession
    name: str = "image_hashes"
    buckets: int = 64

    def write(self, images: DataFrame) -> None:
        """The hashes of all images, instead of those before."""
        rows = images.where("header_hash is not null").select(F.lower("header_hash").alias("hash"), nocase("path").alias("path_key"), "library_id", "id", "path", "file_size")
        rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").mode("overwrite").saveAsTable(self.name)

    def read(self, library_id: int | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        return rows if library_id is None else rows.where(F.col("library_id") == library_id)

    def matched(self, scanned: DataFrame, library_id: int) -> DataFrame:
        """(id, path, file_size, status) of the library's images whose hash was scanned: updated ones have another size now, which is given; the others are skipped."""
        sizes = unique_files(scanned.where("error is null and header_hash is not null")).select(F.lower("header_hash").alias("hash"), F.col("file_size").alias("_size"))
        changed = ~F.col("file_size").eqNullSafe(F.col("_size"))
        return self.read(library_id).join(sizes, "hash").select("id", "path", F.col("_size").alias("file_size"), F.when(changed, "updated").otherwise("skipped").alias("status"))

    def new_files(self, scanned: DataFrame, library_id: int) -> DataFrame:
        """The scanned files whose hash and path the library doesn't have together.

        Only hashes are joined on, so that the buckets do; equal paths are a condition of the join.
        """
        files = scanned.where("error is null and header_hash is not null").withColumns({"_hash": F.lower("header_hash"), "_key": nocase("path")})
        known = self.read(library_id).select("hash", "path_key")
        there = (F.col("_hash") == F.col("hash")) & (F.col("_key") <= F.col("path_key")) & (F.col("_key") >= F.col("path_key"))
        return files.join(known, there, "left_anti").drop("_hash", "_key")

    def duplicates(self, library_id: int) -> DataFrame:
        """(id, hash, path, library_id) of all images whose hash more than one of the library has."""
        repeated = self.read(library_id).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        return self.read().join(repeated, "hash").select("id", "hash", "path", "library_id")
