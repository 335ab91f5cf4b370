"""A catalogue as Parquet tables in versions.

A change writes new files and then a small manifest with the next number, which says which files count; a
reader takes the newest manifest, so readers keep what they read and a failed write leaves nothing that counts.
A manifest is made only if its number is free, so two writers never take one version.

Images are written in batches, each a folder by library and sky zone, and the manifest lists for each library
its batches. So a scan's new files are one batch more, a library whose rows change gets one batch instead of
its others, and other libraries' files are never written again. A manifest keeps the number of each stream's last
batch: a repeated one changes nothing.

Within a zone files are sorted by a finer cell of the sky (Z-order) and time, which is what searches are pruned
by; folded names are stored beside the names, with bloom filters, for exact searches.

Each batch also has its summaries: integration sums by night, and names with their numbers (``plans/rollup.py``). A
version's summary is the sum of its batches', so it changes with the manifest, at once and for no more than what is
written, and plots, suggestions and the index of names don't read images.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sky import CELL_BITS, ZONE_BITS, sky_cell, sky_zone
from ..functions.text import nocase
from ..operators.filters import Filter
from ..schema import IMAGE_FILES, TABLES
from . import rollup
from .names import INDEXED, NameIndex

#: Names whose folded form is stored as ``<name>_key``.
KEYED = INDEXED
STORED = T.StructType([*IMAGE_FILES.fields, T.StructField("sky_cell", T.IntegerType()), *[T.StructField(f"{c}_key", T.StringType()) for c in KEYED], T.StructField("batch", T.StringType()), T.StructField("sky_zone", T.IntegerType())])
#: Ranges of cells that a search asks for; a box of more is covered by coarser ones.
RANGES = 16
#: What is kept of each batch of images: the rows of one image, and the order in which their sums are stored.
SUMMARIES = {"integration": (rollup.integration_rows, ["night"]), "names": (rollup.library_name_rows, ["column", "key"])}
#: A manifest is a file of some kilobytes; a writer that takes longer is lost.
WRITER_SECONDS = 60


class Conflict(RuntimeError):
    """Another writer changed the same library since it was read."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self, name: str, version: int) -> dict:
        """What counts of a version; empty where its writer hasn't finished."""
        fs, path = self._path(name, "_log", f"v{version}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}\n") else {}

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(name, "_log") if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def versions(self, name: str) -> list[int]:
        """Finished versions, in order; each one's manifest is read."""
        return [v for v in self._numbers(name) if self.manifest(name, v)]

    def version(self, name: str) -> int:
        """The newest finished version, 0 where there is none."""
        return self._newest(name)[0]

    def _newest(self, name: str) -> tuple[int, dict]:
        for v in reversed(self._numbers(name)):
            if manifest := self.manifest(name, v):
                return v, manifest
        return 0, {"batches": {}, "streams": {}, "top": 0}

    def _free(self, name: str, version: int) -> int | None:
        """The number after the newest finished version; None while another writer may be at the next one.

        A manifest that stays unfinished for ``WRITER_SECONDS`` has lost its writer, and its number is passed over.
        """
        later = [v for v in self._numbers(name) if v > version]
        if not later:
            return version + 1
        fs, path = self._path(name, "_log", f"v{later[-1]}.json")
        if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < WRITER_SECONDS:
            time.sleep(0.1)
            return None
        return later[-1] + 1

    def _publish(self, name: str, version: int, manifest: dict) -> bool:
        """Write a manifest if its number is free."""
        fs, path = self._path(name, "_log", f"v{version}.json")
        try:
            stream = fs.create(path, False)
        except Exception as e:  # what the store says of a file that is there
            if fs.exists(path):
                return False
            raise e
        try:
            stream.write(bytearray((json.dumps(manifest, sort_keys=True) + "\n").encode()))
        finally:
            stream.close()
        return True

    def read(self, name: str, version: int | None = None, libraries: Iterable[int] | None = None, filters: Iterable[Filter] = (), names: NameIndex | None = None) -> DataFrame:
        """A table's newest or a given version; an empty table where none was written.

        ``libraries``: only their images. ``filters``: only files and row groups that can pass are read (also by
        the names that ``names`` finds to contain a text); they still have to be applied.
        """
        paths = [f"{self.root}/{name}/batch={b}/library_id={lib}" if name == "image_files" else f"{self.root}/{name}/batch={b}" for lib, batches in self._counted(name, version, libraries) for b in batches]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        schema = STORED if name == "image_files" else TABLES[name]
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        if name == "image_files":
            df = reduce(lambda d, f: d if (p := pruned(f, names)) is None else d.where(p), filters, df)
        return df.select(*TABLES[name].names)

    def _write_images(self, df: DataFrame) -> tuple[str, list[str], int]:
        """Write rows as a batch: its name, the libraries it has, and its largest id."""
        batch = uuid.uuid4().hex
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in IMAGE_FILES.fields])
        out = out.withColumns({"sky_cell": sky_cell(F.col("right_ascension"), F.col("declination")), **{f"{c}_key": nocase(c) for c in KEYED}})
        out = out.withColumn("sky_zone", sky_zone(F.col("sky_cell")))
        # Images without coordinates (flats, darks, bias) and those of one busy zone are dealt on by their paths.
        place = F.when(F.col("sky_zone") < 0, F.pmod(F.xxhash64("path"), F.lit(64))).otherwise(F.pmod(F.xxhash64("path"), F.lit(8)))
        laid = out.repartition("library_id", "sky_zone", place).sortWithinPartitions("library_id", "sky_zone", "sky_cell", "observation_timestamp_utc")
        writer = laid.write.partitionBy("library_id", "sky_zone").option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as a file's names need
        for c in KEYED:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}_key", "true").option(f"parquet.bloom.filter.candidates.number#{c}_key", "14")
        writer.parquet(f"{self.root}/image_files/batch={batch}")
        found = [n.partition("=")[2] for n in self._names("image_files", f"batch={batch}") if n.startswith("library_id=")]
        if not found:
            return batch, found, 0
        stored = self.spark.read.schema(STORED).parquet(f"{self.root}/image_files/batch={batch}")
        for kind, (rows, order) in SUMMARIES.items():
            # A library's sums lie together: small ones in one file, large ones cut where the session's partition size says.
            laid = rollup.summed(rows(stored)).hint("rebalance", "library_id").sortWithinPartitions("library_id", *order)
            laid.write.partitionBy("library_id").parquet(f"{self.root}/{kind}/batch={batch}")
        return batch, found, stored.agg(F.max("id")).first()[0] or 0

    def summary(self, kind: str, version: int | None = None, libraries: Iterable[int] | None = None) -> DataFrame:
        """``integration`` or ``names`` of the images of the newest or a given version: what ``plans/rollup.py`` plots and suggests from.

        Batches from before summaries were kept are summed from their images.
        """
        rows = SUMMARIES[kind][0]
        schema = rows(self.spark.createDataFrame([], IMAGE_FILES)).schema
        kept = {n.partition("=")[2] for n in self._names(kind)}
        parts = [(b, lib) for lib, batches in self._counted("image_files", version, libraries) for b in batches]
        stored = [f"{self.root}/{kind}/batch={b}/library_id={lib}" for b, lib in parts if b in kept]
        out = self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*stored).select(*schema.names) if stored else self.spark.createDataFrame([], schema)
        older = [f"{self.root}/image_files/batch={b}/library_id={lib}" for b, lib in parts if b not in kept]
        if older:
            out = out.unionByName(rows(self.spark.read.schema(STORED).option("basePath", f"{self.root}/image_files").parquet(*older)))
        return rollup.summed(out)

    def names(self, version: int | None = None, libraries: Iterable[int] | None = None) -> DataFrame:
        """(column, key, value, n) of the names that can be suggested."""
        every = self.summary("names", version, libraries).where(F.col("column").isin(*rollup.SUGGESTED) & (F.col("value") != ""))
        return rollup.summed(every.drop("library_id"))

    def name_index(self, version: int | None = None, libraries: Iterable[int] | None = None) -> NameIndex:
        """Where contained names are looked up; made from the distinct names, not from images."""
        return NameIndex.of_values(self.summary("names", version, libraries).where("column <> ''").select("column", nocase("value").alias("key")))

    def _counted(self, name: str, version: int | None, libraries: Iterable[int] | None) -> list[tuple[str, list[str]]]:
        """The libraries of a version and their batches."""
        manifest = self._newest(name)[1] if version is None else self.manifest(name, version)
        wanted = None if libraries is None else {_label(x) for x in libraries}
        return [(lib, batches) for lib, batches in sorted(manifest.get("batches", {}).items()) if wanted is None or lib in wanted]

    def write(self, name: str, df: DataFrame) -> int:
        """``df`` as the table's next version, whole; returns its number. ``df`` may read older ones."""
        if name == "image_files":
            batch, found, top = self._write_images(df)
            batches = {lib: [batch] for lib in found}
        else:
            batch, top = uuid.uuid4().hex, 0
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]).write.parquet(f"{self.root}/{name}/batch={batch}")
            batches = {"": [batch]}
        while True:
            version, old = self._newest(name)
            number = self._free(name, version)
            if number and self._publish(name, number, {"batches": batches, "streams": old["streams"], "top": max(top, old["top"])}):
                return number

    def top_id(self) -> int:
        """The largest id that an image has or had."""
        return self._newest("image_files")[1]["top"]

    def taken(self, stream: str) -> int:
        """The number of a stream's last batch, or -1."""
        return self._newest("image_files")[1]["streams"].get(stream, -1)

    def add_images(self, added: DataFrame, library_id: int, kept: DataFrame | None = None, since: int | None = None, stream: str | None = None, number: int = 0) -> int:
        """The next version with ``added`` rows of one library, and with ``kept`` instead of its rows where given; returns its number.

        What is written follows these rows, not the catalogue. ``since``: the version that ``kept`` was made from; if
        another writer has changed the library after it, ``Conflict`` is raised and nothing counts. A batch ``number``
        of ``stream`` that is taken already, or a later one, changes nothing.
        """
        label = _label(library_id)
        rows = added if kept is None else kept.unionByName(added)
        batch, found, top = self._write_images(rows.where(F.col("library_id") == library_id))
        while True:
            version, old = self._newest("image_files")
            if stream is not None and old["streams"].get(stream, -1) >= number:
                self._discard(batch)
                return version
            before = old["batches"].get(label, [])
            if kept is not None and since is not None and since != version and self.manifest("image_files", since).get("batches", {}).get(label, []) != before:
                self._discard(batch)
                raise Conflict(f"library {library_id} was changed after version {since}")
            now = ([] if kept is not None else before) + ([batch] if found else [])
            batches = {k: v for k, v in {**old["batches"], label: now}.items() if v}
            streams = old["streams"] if stream is None else {**old["streams"], stream: number}
            free = self._free("image_files", version)
            if free and self._publish("image_files", free, {"batches": batches, "streams": streams, "top": max(top, old["top"])}):
                return free

    def compact(self, library_id: int) -> int:
        """The next version with a library's batches as one."""
        version = self._newest("image_files")[0]
        rows = self.read("image_files", version, [library_id])
        return self.add_images(rows.limit(0), library_id, kept=rows, since=version)

    def _remove(self, *parts: str) -> None:
        fs, path = self._path(*parts)
        fs.delete(path, True)

    def _discard(self, batch: str) -> None:
        for name in ("image_files", *SUMMARIES):
            self._remove(name, f"batch={batch}")

    def drop_before(self, name: str, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions, and the batches that no version left has."""
        known = self.versions(name)
        held = [self.manifest(name, v)["batches"] for v in known[-keep:]]
        used = {(lib, b) for m in held for lib, batches in m.items() for b in batches}
        for v in known[:-keep]:
            for lib, batches in self.manifest(name, v)["batches"].items():
                for b in batches:
                    if (lib, b) not in used:
                        for part in (name, *(SUMMARIES if name == "image_files" else [])):
                            self._remove(part, f"batch={b}", *([f"library_id={lib}"] if name == "image_files" else []))
        for v in known[:-keep]:
            self._remove(name, "_log", f"v{v}.json")


def _label(library_id: int | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if library_id is None else str(library_id)


def pruned(f: Filter, names: NameIndex | None = None) -> Column | None:
    """What a filter says of the stored columns: sky zones and cells of a coordinate search, folded names of others."""
    known = f.exact_names(names)
    if known:
        return reduce(lambda a, b: a & b, [F.col(f"{c}_key").isin(*sorted(keys)) if keys else F.lit(False) for c, keys in known.items()])
    ranges = f.sky_ranges(RANGES)
    if ranges is None:
        return None
    shift = 2 * (CELL_BITS - ZONE_BITS)
    zones = sorted({z for low, high in ranges for z in range(low >> shift, (high >> shift) + 1)})
    return F.col("sky_zone").isin(*zones) & reduce(lambda a, b: a | b, [F.col("sky_cell").between(low, high) for low, high in ranges])
