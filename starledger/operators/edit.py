"""Changes to catalogue tables: each returns the table's next version as a DataFrame.

Parquet has no row updates, so a change is a plan from old rows to new ones; ``plans.catalog`` writes
it as the table's next version. ``now`` is injected, so a plan gives the same rows when it is repeated.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nocase, nocase_text
from ..schema import APP_SETTINGS, ASTROBIN_FILTERS, HEADER_COLUMNS, LIBRARIES, OBJECT_ALIASES, PERSISTED_FILTERS, TAGS

#: Image columns that a user may edit.
EDITABLE = ("type", "kind", *[c.split()[0] for c in HEADER_COLUMNS.split(", ")])


def _time(now: dt.datetime) -> Column:
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def _without(df: DataFrame, column: str, ids: DataFrame, id_column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(id_column).alias("_out")).distinct(), F.col(column) == F.col("_out"), "left_anti")


def _row(df: DataFrame, schema, values: dict[str, Any]) -> DataFrame:
    """A one-row table of ``schema`` whose id follows the highest of ``df``."""
    top = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return top.select(*[(F.col("top") + 1 if f.name == "id" else values.get(f.name, F.lit(None)) if isinstance(values.get(f.name), Column) else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def delete_images(images: DataFrame, image_tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and image tags without the images of ``ids``."""
    return _without(images, "id", ids), _without(image_tags, "image_id", ids)


def add_library(libraries: DataFrame, now: dt.datetime, name: str = "New Library", path: str = "") -> DataFrame:
    return libraries.unionByName(_row(libraries, LIBRARIES, {"created_on": _time(now), "name": name, "path": path}))


def edit_library(libraries: DataFrame, library_id: int, now: dt.datetime, name: str | None = None, path: str | None = None) -> DataFrame:
    return _edited(libraries, F.col("id") == library_id, {k: v for k, v in {"name": name, "path": path}.items() if v is not None}, now)


def delete_library(libraries: DataFrame, images: DataFrame, image_tags: DataFrame, library_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Libraries, images and image tags without a library and what it holds."""
    gone = images.where(F.col("library_id") == library_id).select("id")
    return libraries.where(F.col("id") != library_id), images.where(~F.col("library_id").eqNullSafe(library_id)), _without(image_tags, "image_id", gone)


def _edited(df: DataFrame, chosen: Column, values: dict[str, Any], now: dt.datetime | None) -> DataFrame:
    """``df`` with values set in chosen rows, and their updated_on."""
    changes = {c: F.when(chosen, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    if now is not None and values:
        changes["updated_on"] = F.when(chosen, _time(now)).otherwise(F.col("updated_on"))
    return df.withColumns(changes) if changes else df


def add_tag(tags: DataFrame, now: dt.datetime, name: str, color: str = "#ffffffff") -> DataFrame:
    return tags.unionByName(_row(tags, TAGS, {"created_on": _time(now), "name": name, "color": color}))


def edit_tag(tags: DataFrame, tag_id: int, now: dt.datetime, name: str | None = None, color: str | None = None) -> DataFrame:
    return _edited(tags, F.col("id") == tag_id, {k: v for k, v in {"name": name, "color": color}.items() if v is not None}, now)


def delete_tag(tags: DataFrame, image_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("id") != tag_id), image_tags.where(F.col("tag_id") != tag_id)


def add_tags(image_tags: DataFrame, image_ids: DataFrame, tag_ids: list[int]) -> DataFrame:
    """Each of a few tags put on each image, once: the tags are exploded in place, not joined."""
    made = image_ids.select(F.col("id").cast("bigint").alias("image_id"), F.explode(F.lit(list(tag_ids)).cast("array<int>")).alias("tag_id"))
    return image_tags.unionByName(made).distinct()


def remove_tags(image_tags: DataFrame, image_ids: DataFrame, tag_ids: list[int]) -> DataFrame:
    chosen = image_ids.select(F.col("id").alias("_image")).distinct()
    return image_tags.join(chosen, (F.col("image_id") == F.col("_image")) & F.col("tag_id").isin(list(tag_ids)), "left_anti")


def clear_tags(image_tags: DataFrame, image_ids: DataFrame) -> DataFrame:
    return _without(image_tags, "image_id", image_ids)


def add_alias(aliases: DataFrame, object_name: str, alias: str) -> DataFrame:
    """Trimmed; an empty name or alias adds nothing."""
    name, other = object_name.strip(), alias.strip()
    return aliases.unionByName(_row(aliases, OBJECT_ALIASES, {"object_name": name, "alias": other})) if name and other else aliases


def delete_alias(aliases: DataFrame, alias_id: int) -> DataFrame:
    return aliases.where(F.col("id") != alias_id)


def delete_aliases_named(aliases: DataFrame, alias: str) -> DataFrame:
    """Without all rows of an alias, without ASCII case."""
    return aliases.where(~nocase("alias").eqNullSafe(nocase_text(alias)))


def bulk_edit(images: DataFrame, ids: DataFrame, values: dict[str, Any], now: dt.datetime) -> DataFrame:
    """Editable columns set in the images of ``ids``; other rows and columns stay."""
    wrong = set(values) - set(EDITABLE)
    if wrong:
        raise ValueError(f"not editable: {sorted(wrong)}")
    marked = images.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    return _edited(marked, F.col("_id").isNotNull(), values, now).drop("_id")


def add_export_filter(filters: DataFrame, astrobin_id: int, name: str, app_settings_id: int = 1) -> DataFrame:
    """Nothing is added where the id is there already."""
    new = _row(filters, ASTROBIN_FILTERS, {"app_settings_id": app_settings_id, "astrobin_id": astrobin_id, "name": name})
    return filters.unionByName(new.join(filters.select(F.col("astrobin_id").alias("_had")), F.col("astrobin_id") == F.col("_had"), "left_anti"))


def remove_export_filter(filters: DataFrame, astrobin_id: int) -> DataFrame:
    return filters.where(F.col("astrobin_id") != astrobin_id)


def set_settings(settings: DataFrame, persisted: DataFrame, **values: bool) -> tuple[DataFrame, DataFrame]:
    """Settings with values set, and the saved filters, which go where filters are no more to be kept."""
    known = set(APP_SETTINGS.names) - {"id"}
    if set(values) - known:
        raise ValueError(f"unknown: {sorted(set(values) - known)}")
    kept = persisted.where(F.lit(values.get("persist_filters_on_exit", True)))
    return settings.withColumns({k: F.lit(v) for k, v in values.items()}), kept


def save_filters(spark, pairs: list[tuple[str, str]], app_settings_id: int = 1) -> DataFrame:
    """The table of persisted filters."""
    return spark.createDataFrame([(i + 1, app_settings_id, name, data) for i, (name, data) in enumerate(pairs)], PERSISTED_FILTERS)
