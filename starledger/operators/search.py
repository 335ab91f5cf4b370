"""Search: filters, then the projection with library name and tags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import IMAGE_FILES
from .filters import Context, Filter, apply_filters

#: Columns of an image that a search result leaves out.
HIDDEN = ("header_hash", "created_on", "updated_on", "library_id")


def tags_by_image(image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(image_id, tags): each image's tags ordered by name and id. The tag table is the small side of the join."""
    named = image_tags.join(tags.select(F.col("id").alias("tag_id"), "name", "color"), "tag_id")
    return named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("tag_id").alias("id"), "color"))).alias("tags"))


def search(images: DataFrame, libraries: DataFrame, tags: DataFrame, image_tags: DataFrame, aliases: DataFrame | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """The images that pass all filters, with library_name and tags; not ordered and not limited.

    Tags are nested before they meet the images, so an image stays one row, and images are read once and dealt out by id once.
    """
    found = apply_filters(filters, Context(images, aliases, image_tags), images)
    named = found.join(libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name")), "library_id")
    tagged = named.join(tags_by_image(image_tags, tags).withColumnRenamed("image_id", "id"), "id", "left")
    empty = F.array().cast(tagged.schema["tags"].dataType)
    return tagged.select(*[c for c in IMAGE_FILES.names if c not in HIDDEN and c in images.columns], "library_name", F.coalesce("tags", empty).alias("tags"))
