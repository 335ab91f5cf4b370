"""Suggestions for a half-typed value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains

#: Suggestions shown.
MOST = 25


def suggestions(columns: list[tuple[DataFrame, str]], text: str | None, most: int = MOST) -> DataFrame:
    """Up to ``most`` values that contain the text, of one or several columns: not empty, once without case, in order.

    Blank text gives none. Values are grouped before the top is taken, so only ``most`` rows a task move on.
    """
    parts = [df.select(F.col(c).alias("value")).where(contains("value", text) if text and text.strip() else F.lit(False)) for df, c in columns]
    values = reduce(DataFrame.unionByName, parts).where(F.col("value") != "")
    return values.groupBy(F.lower("value").alias("key")).agg(F.min("value").alias("value")).orderBy("key").limit(most).select("value")


def alias_names(aliases: DataFrame, object_names: DataFrame, text: str) -> DataFrame:
    """Names to look for when ``text`` is searched: itself, objects of matching aliases, matching objects; once without case."""
    one = aliases.sparkSession.range(1).select(F.lit(text).alias("name"))
    named = aliases.where(contains("alias", text)).select(F.col("object_name").alias("name"))
    own = object_names.where(contains("object_name", text)).select(F.col("object_name").alias("name"))
    return one.union(named).union(own).where("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("name")


def names_with_aliases(object_names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(object_name, aliases): each object's name once, with its aliases in order; names meet without case."""
    grouped = aliases.groupBy(F.lower("object_name").alias("key")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    names = object_names.where("object_name is not null").select("object_name").distinct().withColumn("key", F.lower("object_name"))
    return names.join(grouped, "key", "left").select("object_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).orderBy("object_name")
