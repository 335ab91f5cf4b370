"""Walking folders for image files, level by level.

The folders of a level are a table, listed by as many tasks as there are; the folders they hold, by the rules
below as column expressions, are the next level's. So each folder is listed once, whatever the tree's shape,
and nothing but the number of levels is known to the driver. ``folders`` and ``walk`` are the stream source's
form of it, which has no session where it plans.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filename
from ..shared import checkpointed
from .store import entries

EXTENSIONS = (".fit", ".fits", ".xisf")
SKIPPED = ("site-packages",)
#: Files that a task reads of a folder whose files are counted, and the tasks that share a tree that isn't.
SHARE_FILES, TREE_SHARES = 1000, 4
#: Folders that one task lists, and rows that it hands on at once.
TASK_FOLDERS, BATCH = 32, 1000

LISTED = "path string, is_folder boolean, file_size long, modified double, created double"


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    modified: float
    created: float


def wanted_folder(name: str, is_root: bool = False) -> bool:
    """Folders named $..., and below the root .... and site-packages, are not walked."""
    return not name.startswith("$") and (is_root or not name.startswith(".") and name not in SKIPPED)


def wanted_file(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in EXTENSIONS


def walks_folder(name: Column, is_root: bool = False) -> Column:
    """``wanted_folder`` as a column."""
    skipped = name.startswith("$")
    return ~skipped if is_root else ~(skipped | name.startswith(".") | name.isin(*SKIPPED))


def walks_file(name: Column) -> Column:
    """``wanted_file`` as a column; a name of points and an extension only has none."""
    return reduce(lambda a, b: a | b, [F.lower(name).rlike(rf"[^.].*\{e}$") for e in EXTENSIONS])


def walks_path(path: Column, root: Column) -> Column:
    """Whether a walk of ``root`` comes to the file ``path`` below it."""
    below = F.substr(path, F.length(root) + 2, F.length(path))
    parts = F.split(below, "/")
    return path.startswith(F.concat(root, F.lit("/"))) & walks_folder(filename(root), True) & F.forall(F.slice(parts, 1, F.size(parts) - 1), lambda name: walks_folder(name)) & walks_file(filename(path))


def changed_since(since: Column) -> Column:
    """Modified or created at that time or later (seconds)."""
    return (F.col("modified") >= since) | (F.col("created") >= since)


def list_folders(folders: DataFrame, tasks: int) -> DataFrame:
    """(path, is_folder, file_size, modified, created) of all that the given folders hold, listed by so many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "is_folder", "file_size", "modified", "created"])

        rows = []
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            for e in entries(folder):
                rows.append((e.path, e.is_folder, e.size, e.modified, e.created))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return folders.repartition(tasks, "path").mapInArrow(run, LISTED)


def walk_tree(spark: SparkSession, root: str, since: float | None = None, until: float | None = None) -> DataFrame:
    """(path, file_size, modified, created) of the image files below ``root`` in any store; times are seconds.

    With ``since``, those modified or created at that time or later, with ``until`` before it. One job for each
    level of the tree; a root that isn't there, or is named $..., gives no rows.
    """
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string").where(walks_folder(filename("path"), True))
    count, found = level.count(), []
    while count:
        listed = checkpointed(list_folders(level, -(-count // TASK_FOLDERS)))
        found.append(listed.where(~F.col("is_folder") & walks_file(filename("path"))))
        level = listed.where(F.col("is_folder") & walks_folder(filename("path"))).select("path")
        count = level.count()
    files = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LISTED)
    newest = F.greatest("modified", "created")
    for bound, keep in ((since, lambda x: changed_since(F.lit(x))), (until, lambda x: newest < x)):
        files = files if bound is None else files.where(keep(bound))
    return files.select("path", "file_size", "modified", "created")


def folders(root: str, depth: int = 2) -> list[tuple[str, bool, int]]:
    """Parts of a tree to be walked apart, down to ``depth`` levels: (folder, whether with all below it, among how many tasks its files are shared)."""
    if not wanted_folder(os.path.basename(os.path.normpath(root)), True):
        return []
    parts, level = [], [root]
    for _ in range(depth):
        below = []
        for folder in level:
            files = 0
            for e in entries(folder):
                name = os.path.basename(e.path)
                if not e.is_folder:
                    files += wanted_file(name)
                elif wanted_folder(name):
                    below.append(e.path)
            parts.append((folder, False, files // SHARE_FILES + 1))
        level = sorted(below)
    return parts + [(folder, True, TREE_SHARES) for folder in level]


def walk(folder: str, deep: bool = True, since: float | None = None, until: float | None = None, share: tuple[int, int] = (0, 1)) -> Iterator[Found]:
    """Image files in a folder, in no set order; with ``since``, those modified or created at that time or later.

    ``share``: of (k, n), only the files whose path's checksum leaves k of n.
    """
    todo = [folder]
    while todo:
        for e in entries(todo.pop()):
            name = os.path.basename(e.path)
            if e.is_folder:
                if deep and wanted_folder(name):
                    todo.append(e.path)
            elif wanted_file(name) and zlib.crc32(os.fsencode(e.path)) % share[1] == share[0]:
                newest = max(e.modified, e.created)
                if (since is None or newest >= since) and (until is None or newest < until):
                    yield Found(e.path, e.size, e.modified, e.created)
