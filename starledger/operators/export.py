"""Acquisition exports, summaries and file copies."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_as_none, filename, hours_text, nocase
from ..schema import IMAGE_TYPES
from ..sources.store import copy_named, file_state, remove_folder

#: Folder below an export's target where files are copied before they get their names.
STAGING = "_staged"

#: Answer of the equipment service: the fields that are read.
FILTER_ANSWER = T.StructType([T.StructField("count", T.IntegerType()), T.StructField("results", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("brandName", T.StringType()), T.StructField("name", T.StringType())])))])


def equipment_filters(answers: DataFrame, column: str = "json") -> DataFrame:
    """(id, name) of the filters in JSON answers of the equipment service; the name is brand and name."""
    rows = answers.select(F.from_json(column, FILTER_ANSWER).alias("answer")).select(F.inline("answer.results"))
    return rows.select("id", F.concat_ws(" ", "brandName", "name").alias("name"))


def acquisition_groups(images: DataFrame) -> DataFrame:
    """(filter_name, seconds, count) of light frames; filter names meet without case, blank ones are 'None', null exposure is 0."""
    lights = images.where(F.col("type") == IMAGE_TYPES["Light"]).select(blank_as_none("filter_name").alias("filter_name"), F.coalesce("exposure", F.lit(0.0)).alias("seconds"))
    return lights.groupBy(F.lower("filter_name").alias("key"), "seconds").agg(F.min("filter_name").alias("filter_name"), F.count("*").alias("count")).select("filter_name", "seconds", "count")


def mapped_groups(groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """Groups whose filter has a row in ``mapping`` (name, astrobin_id; a null id leaves the filter out of the export)."""
    side = mapping.select(nocase("name").alias("_name"), "astrobin_id")
    return groups.join(side, nocase("filter_name") == F.col("_name")).select("filter_name", "astrobin_id", "seconds", "count")


def acquisition_lines(groups: DataFrame) -> DataFrame:
    """(position, line) of the acquisition CSV: the header, then the groups by filter and duration. The id column is there if any group has an id."""
    any_id = groups.agg(F.coalesce(F.max(F.col("astrobin_id").isNotNull()), F.lit(False)).alias("any_id"))
    header = any_id.select(F.lit("").alias("filter_name"), F.lit(-1.0).alias("seconds"), F.when(F.col("any_id"), "filter,number,duration").otherwise("number,duration").alias("line"))
    number = F.concat_ws(",", F.col("count").cast("string"), F.format_string("%.4f", "seconds"))
    lines = groups.join(F.broadcast(any_id), F.lit(True)).select("filter_name", "seconds", F.when(F.col("any_id"), F.concat(F.coalesce(F.col("astrobin_id").cast("string"), F.lit("")), F.lit(","), number)).otherwise(number).alias("line"))
    return header.unionByName(lines).orderBy("filter_name", "seconds", "line").select("line")


def acquisition_csv(groups: list[tuple[int, float, int | None]]) -> str:
    """The CSV of (count, seconds, filter id) groups, in the order given."""
    any_id = any(g[2] is not None for g in groups)
    lines = ["filter,number,duration" if any_id else "number,duration"]
    for count, seconds, filter_id in groups:
        lines.append((f"{'' if filter_id is None else filter_id}," if any_id else "") + f"{count},{seconds:.4f}")
    return "\n".join(lines) + "\n"


def summary_lines(statistics: DataFrame) -> DataFrame:
    """(line) of the integration summary of ``stats.integration_by_filter``: the total, then the filters, most seconds first."""
    hours = lambda: F.concat(hours_text(F.col("seconds") / 3600), F.lit(" hr"))
    total = statistics.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")).select(F.lit(0).alias("part"), "seconds", F.lit("").alias("filter"), F.concat(F.lit("Total Integration: "), hours()).alias("line"))
    each = statistics.select(F.lit(1).alias("part"), "seconds", "filter", F.concat(F.col("filter"), F.lit(": "), hours()).alias("line"))
    return total.unionByName(each).orderBy("part", F.desc("seconds"), "filter").select("line")


def markdown_lines(statistics: DataFrame) -> DataFrame:
    """(line) of the same as a Markdown table with a total, which always has one decimal; the columns' widths are one row."""
    cells = statistics.select(F.lit(2).alias("part"), "seconds", "filter", F.col("count").cast("string").alias("n"), hours_text(F.col("seconds") / 3600).alias("hours"))
    total = statistics.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")).select(F.lit(3).alias("part"), "seconds", F.lit("Total").alias("filter"), F.lit("").alias("n"), F.concat(F.format_string("%.1f", F.col("seconds") / 3600), F.lit(" hr")).alias("hours"))
    width = lambda name, least: F.greatest(F.lit(least), F.coalesce(F.max(F.length(name)), F.lit(0)))
    widths = cells.unionByName(total).agg(width("filter", len("Filter")).alias("a"), width("n", len("Exposures")).alias("b"), width("hours", len("Integration")).alias("c"))
    titles = widths.select(F.lit(0).alias("part"), F.lit(0.0).alias("seconds"), F.lit("Filter").alias("filter"), F.lit("Exposures").alias("n"), F.lit("Integration").alias("hours"))
    a, b, c = (F.col(x) for x in "abc")
    # An hours text is measured without its unit, so it can be wider than its column.
    shown = F.when(F.col("part") == 2, F.concat("hours", F.lit(" hr"))).otherwise(F.col("hours"))
    row = F.concat(F.lit("| "), F.rpad("filter", a, F.lit(" ")), F.lit(" | "), F.lpad("n", b, F.lit(" ")), F.lit(" | "), F.lpad(shown, F.greatest(c, F.length(shown)), F.lit(" ")), F.lit(" |"))
    rows = titles.unionByName(cells).unionByName(total).join(F.broadcast(widths), F.lit(True)).select("part", "seconds", "filter", row.alias("line"))
    dashes = lambda n: F.repeat(F.lit("-"), n)
    rule = widths.select(F.lit(1).alias("part"), F.lit(0.0).alias("seconds"), F.lit("").alias("filter"), F.concat(F.lit("|"), dashes(a + 2), F.lit("|"), dashes(b + 1), F.lit(":|"), dashes(c + 1), F.lit(":|")).alias("line"))
    return rows.unionByName(rule).orderBy("part", F.desc("seconds"), "filter").select("line")


def copy_plan(paths: DataFrame, taken: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """(path, name, copies): the file name that each path gets in a flat folder, and whether it is copied.

    Of equal names the least path is; names in ``taken`` (name) are left as they are unless ``overwrite``.
    """
    named = paths.where("path is not null").select("path", filename("path").alias("name")).distinct()
    least = named.groupBy("name").agg(F.min("path").alias("_least"))
    if taken is not None and not overwrite:
        least = least.join(taken.select("name").distinct(), "name", "left_anti")
    return named.join(least, "name", "left").select("path", "name", F.coalesce(F.col("path") == F.col("_least"), F.lit(False)).alias("copies"))


def copy_files(paths: DataFrame, target: str, overwrite: bool = False, buffer: int = 2 << 20) -> DataFrame:
    """(path, copied, error): each file copied flat into ``target``, a folder of a store that all workers reach.

    Missing files are skipped, as are names that are there unless ``overwrite``; of equal names in one
    export the least path is copied. A task copies a file into a staging folder of its own attempt and then gives
    it its name, so a lost task leaves no half file under a name; a file that an earlier attempt of the
    export has named counts as copied and isn't copied again. ``remove_staged`` clears what lost tasks left.
    """
    chosen = copy_plan(paths).where("copies")
    export, began = uuid.uuid4().hex, time.time()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        staging = f"{target}/{STAGING}/{export}-{task.partitionId()}-{task.taskAttemptId()}"
        for batch in batches:
            rows = []
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), strict=True):
                copied, error = False, None
                try:
                    size, there = file_state(path), file_state(f"{target}/{name}")
                    if size is not None and there is not None and there[0] == size[0] and there[1] >= began:
                        copied = True
                    elif size is not None and (overwrite or there is None):
                        copied = copy_named(path, f"{staging}/{name}", f"{target}/{name}", overwrite, buffer)
                except OSError as e:
                    error = str(e)
                rows.append((path, copied, error))
            a, b, c = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.bool_()), pa.array(c, pa.string())], ["path", "copied", "error"])
        remove_folder(staging)

    return chosen.select("path", "name").mapInArrow(run, "path string, copied boolean, error string")


def remove_staged(target: str) -> None:
    """Remove what lost tasks of finished exports left below ``target``."""
    remove_folder(f"{target}/{STAGING}")
