"""Ingest: scanned headers against the catalogue, as joins.

Each scanned file is matched to the rows of its library with the same header hash. Rows that are there
get the new file size (updated) or stay (skipped); a file whose hash and path are not there together is
parsed and added, even where only its path is new, which is how duplicates come about. Errors are rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nocase
from ..schema import IMAGE_FILES
from .headers import with_header_columns


@dataclass
class Ingest:
    """The next images of a library's scan, what is new among them, and a status for each file or row met."""

    images: DataFrame
    added: DataFrame
    statuses: DataFrame
    kept: DataFrame  # the library's rows that were there, with their new sizes
    changed: DataFrame  # those of them that got one

    def summary(self) -> DataFrame:
        """(status, count): added, updated, skipped, error."""
        return self.statuses.groupBy("status").agg(F.count("*").alias("count"))


def unique_files(scanned: DataFrame) -> DataFrame:
    """One row for each header hash: the file of the least path."""
    named = [c for c in scanned.columns if c != "header_hash"]
    best = scanned.where("header_hash is not null").groupBy("header_hash").agg(F.min_by(F.struct(*named), "path").alias("_file"))
    return best.select("header_hash", "_file.*").select(*scanned.columns)


def ingest(images: DataFrame, scanned: DataFrame, library_id: int, now: dt.datetime, top: int | None = None) -> Ingest:
    """Plan of a scan of one library: ``scanned`` has the columns of the header source.

    ``top``: the largest id in use, where it is known; then ``images`` need only have the library's rows.
    """
    time = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    good, bad = scanned.where("error is null and header_hash is not null"), scanned.where("error is not null or header_hash is null")
    own = images.where(F.col("library_id") == library_id)
    sizes = unique_files(good).select(F.lower("header_hash").alias("_hash"), F.col("file_size").alias("_size"))
    matched = own.join(sizes, F.lower("header_hash") == F.col("_hash"), "left")
    met = F.col("_hash").isNotNull()
    changed = met & ~F.col("file_size").eqNullSafe(F.col("_size"))
    sized = {"updated_on": F.when(changed, time).otherwise(F.col("updated_on")), "file_size": F.when(met, F.col("_size")).otherwise(F.col("file_size"))}
    kept = matched.withColumns(sized).select(*images.columns)
    known = own.select(F.lower("header_hash").alias("_hash"), nocase("path").alias("_path")).distinct()
    new_files = good.join(known, (F.lower("header_hash") == F.col("_hash")) & (nocase("path") == F.col("_path")), "left_anti")
    highest = images.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")) if top is None else images.sparkSession.range(1).select(F.lit(top).cast("bigint").alias("_top"))
    parsed = with_header_columns(new_files.drop("created")).withColumns({"library_id": F.lit(library_id), "created_on": time, "updated_on": F.lit(None).cast("timestamp_ntz"), "_n": F.monotonically_increasing_id()})
    added = parsed.join(F.broadcast(highest), F.lit(True)).withColumn("id", F.col("_top") + F.col("_n") + 1).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in IMAGE_FILES.fields])
    statuses = (
        matched.where(met).select(F.col("path"), F.when(changed, "updated").otherwise("skipped").alias("status"))
        .unionByName(new_files.select("path", F.lit("added").alias("status")))
        .unionByName(bad.select("path", F.lit("error").alias("status")))
    )
    others = images.where(~F.col("library_id").eqNullSafe(library_id))
    return Ingest(others.unionByName(kept).unionByName(added.select(*images.columns)), added, statuses, kept, matched.where(changed).withColumns(sized).select(*images.columns))


def scanned_at(libraries: DataFrame, library_id: int, now: dt.datetime) -> DataFrame:
    """Libraries with ``last_scan`` set; to be written after the scan's images are."""
    return libraries.withColumn("last_scan", F.when(F.col("id") == library_id, F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")).otherwise(F.col("last_scan")))
