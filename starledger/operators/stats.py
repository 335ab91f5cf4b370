"""Statistics of a search result, and counts for the catalogue's lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import gigabytes_text, hours_text
from ..schema import IMAGE_TYPES


def integration_by_filter(images: DataFrame) -> DataFrame:
    """Light frames by filter name, case-sensitively: filter ('None' for null, apart from a filter of that name), count, seconds; most seconds first."""
    lights = images.where(F.col("type") == IMAGE_TYPES["Light"])
    sums = lights.groupBy("filter_name").agg(F.count("*").alias("count"), F.sum(F.coalesce("exposure", F.lit(0.0))).alias("seconds"))
    return sums.select(F.coalesce("filter_name", F.lit("None")).alias("filter"), "count", "seconds").orderBy(F.desc("seconds"), "filter")


def totals(images: DataFrame) -> DataFrame:
    """One row: light seconds and hours text, the five type counts and their text, total size and its text."""
    is_light = F.col("type") == IMAGE_TYPES["Light"]
    known = list(IMAGE_TYPES.values())[1:]
    counts = [F.count_if(F.col("type") == IMAGE_TYPES[t]).alias(t.lower()) for t in ("Light", "Flat", "Dark", "Bias")]
    sums = images.agg(F.coalesce(F.sum(F.when(is_light, F.coalesce("exposure", F.lit(0.0)))), F.lit(0.0)).alias("seconds"), *counts, F.count_if(~F.col("type").isin(known) | F.col("type").isNull()).alias("unknown"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))
    return sums.select("seconds", hours_text(F.col("seconds") / 3600).alias("total_integration"), "light", "flat", "dark", "bias", "unknown", F.concat_ws("/", *[F.col(c).cast("string") for c in ("light", "flat", "dark", "bias", "unknown")]).alias("type_counts"), F.col("total_size").cast("bigint").alias("total_size"), gigabytes_text(F.col("total_size")).alias("total_size_text"))


def distinct_objects(images: DataFrame) -> DataFrame:
    """Names of light frames' objects, case-sensitively, in order."""
    return images.where((F.col("type") == IMAGE_TYPES["Light"]) & F.col("object_name").isNotNull()).select("object_name").distinct().orderBy("object_name")


def tag_usage(image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Each tag with the number of its images, last id first."""
    used = image_tags.groupBy("tag_id").agg(F.count("*").alias("images"))
    return tags.join(used, tags["id"] == used["tag_id"], "left").select("id", "name", F.coalesce("images", F.lit(0)).alias("images")).orderBy(F.desc("id"))


def library_counts(images: DataFrame, libraries: DataFrame) -> DataFrame:
    """Each library with the number of its images."""
    used = images.groupBy("library_id").agg(F.count("*").alias("images"))
    return libraries.join(used, libraries["id"] == used["library_id"], "left").select("id", "name", F.coalesce("images", F.lit(0)).alias("images"))


def can_delete_library(libraries: DataFrame) -> DataFrame:
    """One row: whether there is more than one library."""
    return libraries.agg((F.count("*") > 1).alias("can_delete"))


def tags_of_selection(image_ids: DataFrame, image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The tags that any of the images has, once each."""
    used = image_tags.join(image_ids.select(F.col("id").alias("image_id")).distinct(), "image_id", "left_semi").select("tag_id").distinct()
    return tags.join(used, tags["id"] == used["tag_id"], "left_semi")


def common_values(images: DataFrame, columns: list[str], many: str = "<Multiple Values>") -> DataFrame:
    """One row: for each column the one value that all rows have, as text, or ``many``. Null is a value.

    Least and greatest values tell, so all columns are read in one pass without distinct counts.
    """
    varied = {c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in columns}
    return images.agg(*[F.when(v, F.lit(many)).otherwise(F.max(F.col(c).cast("string"))).alias(c) for c, v in varied.items()])
