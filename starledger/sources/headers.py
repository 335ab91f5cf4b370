"""Headers of image files: one row per file, as a table of a tree in any store, and as the data source ``image_headers``.

``scan_headers`` lists a tree level by level and deals its files out to tasks, which read header bytes only. The stream
``scan_times`` says for each batch from when up to when files count, for a ``scan_headers`` of any tree in that batch.
``spark.readStream.format("image_headers").load(root)`` is the stream of files that change (and ``spark.read``
the same in one batch); options: ``since`` (seconds, the incremental scan's cutoff), ``compat_xisf_hash``. A file that
can't be read is a row with an error.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import HEADER, SCANNED
from ..shared import checkpointed
from . import fits, listing, xisf
from .store import opened

#: Files whose headers one task reads.
TASK_FILES = 256


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool, share: tuple[int, int], since: float | None = None, until: float | None = None) -> None:
        self.path, self.deep, self.share, self.since, self.until = path, deep, share, since, until


def read_file(path: str, compat_xisf_hash: bool = False) -> tuple[str | None, dict | None, str | None]:
    """Hash and header of a file, or what is wrong with it."""
    try:
        with opened(path) as stream:
            header, digest = xisf.read_header(stream, compat_xisf_hash) if path.lower().endswith(".xisf") else fits.read_header(stream)
        return digest, header, None
    except (OSError, ValueError) as e:
        return None, None, f"{type(e).__name__}: {e}"


def moment(seconds: float) -> dt.datetime:
    """A file's time, to the nearest microsecond."""
    return dt.datetime.fromtimestamp(seconds, dt.UTC).replace(tzinfo=None)


def micros(seconds: float) -> int:
    """The same as a number; multiplying the seconds would be off by one at times."""
    return (moment(seconds) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def scan_file(found: listing.Found, compat_xisf_hash: bool = False) -> tuple:
    """A row of the source."""
    digest, header, error = read_file(found.path, compat_xisf_hash)
    row = header and (header["width"], header["height"], header["file_extension"], [tuple(i[k] for k in ("keyword", "kind", "s", "b", "i", "d", "comment")) for i in header["items"]])
    return found.path, found.size, moment(found.modified), moment(found.created), digest, row, error


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> StructType:
        return SCANNED

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return HeaderStreamReader(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.since = float(options["since"]) if options.get("since") else None
        self.compat = str(options.get("compat_xisf_hash", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [Folder(path, deep, (k, shares), self.since) for path, deep, shares in listing.folders(self.root) for k in range(shares)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for found in listing.walk(partition.path, partition.deep, partition.since, partition.until, partition.share):
            yield scan_file(found, self.compat)


class HeaderStreamReader(HeaderReader, DataSourceStreamReader):
    """Offsets are times: a batch has the files changed from the last offset up to the next."""

    def initialOffset(self) -> dict:
        return {"time": self.since or 0.0}

    def latestOffset(self) -> dict:
        return {"time": time.time()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Folder(path, deep, (k, shares), start["time"], end["time"]) for path, deep, shares in listing.folders(self.root) for k in range(shares)]

    def commit(self, end: dict) -> None:
        pass


class Times(InputPartition):
    def __init__(self, since: float, until: float) -> None:
        self.since, self.until = since, until


class TimesSource(DataSource):
    """One row a batch; a batch that is run again has the same times, as they are the stream's offsets."""

    @classmethod
    def name(cls) -> str:
        return "scan_times"

    def schema(self) -> str:
        return "since double, until double"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TimesReader(self.options)


class TimesReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.since = float(options.get("since") or 0.0)

    def initialOffset(self) -> dict:
        return {"time": self.since}

    def latestOffset(self) -> dict:
        return {"time": time.time()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Times(start["time"], end["time"])]

    def read(self, partition: Times) -> Iterator[tuple]:
        yield partition.since, partition.until

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeaderSource)
    spark.dataSource.register(TimesSource)


def estimated_count(spark: SparkSession, root: str) -> int:
    """Files that a full scan would find: an aggregate of the distributed listing."""
    return listing.walk_tree(spark, root).count()


def scan_headers(spark: SparkSession, root: str, since: float | None = None, until: float | None = None, compat_xisf_hash: bool = False) -> DataFrame:
    """The rows of the data source for a tree in any store, listed and read by as many tasks as it has work for.

    A file's own task reads its header by ranges from the front; files of one folder go to different tasks.
    """
    files = checkpointed(listing.walk_tree(spark, root, since, until))
    tasks = max(1, -(-files.count() // TASK_FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size, modified, created in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, header, error = read_file(path, compat_xisf_hash)
                rows.append((path, size, micros(modified), micros(created), digest, header and json.dumps(header), error))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], SCANNED.names)

    read = files.repartition(tasks, "path").mapInArrow(run, "path string, file_size long, modified long, created long, header_hash string, header string, error string")
    timestamp = lambda c: F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(CAST({c} AS DECIMAL(20, 0)) / 1000000 AS DECIMAL(18, 6)))")
    return read.withColumns({"modified": timestamp("modified"), "created": timestamp("created"), "header": F.from_json("header", HEADER)})


def read_bytes(df: DataFrame, content: str = "content", form: str = "fits") -> DataFrame:
    """``df`` with header_hash, header and error read from a binary column that holds files or their first bytes.

    For stores that the header source's paths don't reach, as after ``spark.read.format("binaryFile")``.
    """
    reader = {"fits": fits.read_header, "xisf": xisf.read_header}[form]
    made = ("header_hash", "header", "error")
    schema = StructType([*df.drop(*made).schema.fields, *[StructField(n, StringType()) for n in made]])

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(content).to_pylist():
                try:
                    header, digest = reader(io.BytesIO(data or b""))
                    rows.append((digest, json.dumps(header), None))
                except Exception as e:  # any broken file is a row with its error
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in made]
            read = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + read, [n for n, _ in kept] + list(made))

    return df.drop(*made).mapInArrow(run, schema).withColumn("header", F.from_json("header", HEADER))
