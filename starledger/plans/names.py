"""Names beside a catalogue: its distinct values, and which of them have which three letters in a row.

A search for contained text looks up the letters of its pattern in the postings, keeps the values that have all
of them, and tests these with the pattern itself; images are then met by their folded name. So a search reads
the postings of a few letters and the images of the names found, not a column of all images.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_pattern, nocase, nocase_text

#: Columns with an index. A path is a value of one image, so it is searched as it is.
INDEXED = ("camera_name", "filter_name", "filter_wheel_name", "focuser_name", "object_name", "readout_mode", "rotator_name", "telescope_name")
GRAM = 3
#: Found names that are put into the scan as a list; more are joined.
LISTED_NAMES = 1000


def grams_of_pattern(text: str) -> list[str]:
    """What every value has that contains the text: the runs of letters between its wild signs."""
    return sorted({s[i : i + GRAM] for s in re.split("[%_]", nocase_text(text)) for i in range(len(s) - GRAM + 1)})


def _grams(key: Column) -> Column:
    return F.when(F.length(key) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - (GRAM - 1)), lambda i: F.substr(key, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass
class NameIndex:
    """``values`` (column, key) and ``postings`` (column, gram, key); a key is a folded name."""

    values: DataFrame
    postings: DataFrame

    @staticmethod
    def of(images: DataFrame) -> NameIndex:
        names = F.array(*[F.struct(F.lit(c).alias("column"), nocase(c).alias("key")) for c in INDEXED])
        return NameIndex.of_values(images.select(F.inline(names)))

    @staticmethod
    def of_values(values: DataFrame) -> NameIndex:
        """From (column, key) rows in any number, as those that a rollup of names keeps."""
        keys = values.where("key is not null").select("column", "key").distinct()
        return NameIndex(keys, keys.select("column", F.explode(_grams(F.col("key"))).alias("gram"), "key"))

    def write(self, path: str) -> None:
        """As Parquet, in the order in which it is searched."""
        for name, df, order in (("values", self.values, ["column", "key"]), ("postings", self.postings, ["column", "gram", "key"])):
            df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> NameIndex:
        return NameIndex(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/postings"))

    def containing(self, column: str, text: str) -> DataFrame:
        """(key) of a column's values that contain the text, wild signs and all."""
        grams = grams_of_pattern(text)
        if grams:
            found = self.postings.where((F.col("column") == column) & F.col("gram").isin(*grams)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        else:
            found = self.values.where(F.col("column") == column)
        return found.where(F.col("key").like(contains_pattern(text))).select("key")

    def listed(self, column: str, text: str) -> list[str] | None:
        """The keys as a list, or None where there are more than ``LISTED_NAMES``."""
        rows = self.containing(column, text).limit(LISTED_NAMES + 1).collect()
        return None if len(rows) > LISTED_NAMES else sorted(r["key"] for r in rows)

    def kept(self, images: DataFrame, column: str, text: str) -> DataFrame:
        """The images whose column contains the text."""
        keys = self.listed(column, text)
        if keys is not None:
            return images.where(nocase(column).isin(*keys) if keys else F.lit(False))
        return images.join(self.containing(column, text).withColumnRenamed("key", "_found"), nocase(column) == F.col("_found"), "left_semi")
