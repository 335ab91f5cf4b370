"""Shared plumbing of the training-data operators: tables, checkpoints, Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold; texts are long, so batches stay far below Spark's default.
ARROW_ROWS = 1000
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark can read)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the context's checkpoint folder or the session's ``spark.checkpoint.dir``.

    Only on one machine (tests) a temporary one is made; on a cluster it must be set.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="starledger-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def released(df: DataFrame) -> None:
    """Remove the files of a checkpointed table that nothing read later depends on."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    if rdd.getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffles_removed(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step(docs, ...)`` with the shuffle files of each of its jobs removed when the job ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(step)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            return step(docs, *args, **kwargs)
        finally:
            if before is None:
                conf.unset(key)
            else:
                conf.set(key, before)

    return run


#: Numbers that one row of bits covers, and rows of bits (4 kB each) that may be broadcast.
BITS, BROADCAST_BITS = 1 << 15, 1 << 11


def rows_of_numbers(df: DataFrame, numbers: DataFrame, number: F.Column) -> DataFrame:
    """The rows of ``df`` whose ``number`` (a long, from 0 on) is in the only column of ``numbers``.

    The numbers are sent to all workers as bits, if they lie in a bounded number of runs of BITS, so no row of ``df`` is shuffled.
    """
    of, bits, value = fresh(df, "_of", "_bits", "_value")
    numbers = numbers.toDF(value)
    run, at = lambda x: F.shiftright(x, 15), lambda x: x.bitwiseAND(BITS - 1)
    placed = numbers.withColumn(of, run(F.col(value))).repartition(of)  # else each task would send all runs' bits
    sent = checkpointed(placed.groupBy(of).agg(F.bitmap_construct_agg(at(F.col(value))).alias(bits)))
    if sent.count() > BROADCAST_BITS:
        return df.join(numbers, number == F.col(value), "left_semi")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at(number), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(sent), (run(number) == F.col(of)) & (F.getbit(byte, at(number).bitwiseAND(7).cast("int")) == 1), "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_text(col) -> F.Column:
    """Unsigned crc32 of a value written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes, one row at least."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side of ``rows`` counted rows, but only up to ``limit`` of them."""
    return F.broadcast(df) if rows <= limit else df


def ranked(df: DataFrame, order: list[F.Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in a total order: a range-partitioned sort, and the sizes of the partitions before.

    No task holds more than its range of the rows; only one number for each partition is gathered.
    """
    part, at = fresh(df, "_part", "_at")
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(F.col(part), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))
    return placed.join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col(at)).drop(part, at)
