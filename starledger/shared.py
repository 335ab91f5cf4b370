"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

_held: ContextVar[list[DataFrame] | None] = ContextVar("_held", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """The files of checkpoints that this thread makes within are removed at the end; for jobs that run again and again."""
    made: list[DataFrame] = []
    token = _held.set(made)
    try:
        yield
    finally:
        _held.reset(token)
        for df in made:
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint below ``spark.checkpoint.dir``; only on one machine (tests) a temporary folder stands in."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="starledger-checkpoint-")
        sc.setCheckpointDir(folder)
    out = df.checkpoint()
    if (held := _held.get()) is not None:
        held.append(out)
    return out
