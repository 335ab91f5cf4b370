"""Continuous ingest: files that change below a library's folder become catalogue versions.

Each micro-batch lists the folder's tree level by level in tasks, as a scan does, and takes the files that changed
between its two times; they are planned against the library's rows. New files
are written as one more batch of the library; its other rows are written again only if some of them changed, other
libraries' never. The catalogue knows the number of the stream's last batch, so a repeated one changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Catalog
from ..plans.ingest import ingest, scanned_at
from ..shared import checkpointed, temporary
from ..sources.headers import register, scan_headers


def ingest_stream(spark: SparkSession, catalog: Catalog, library_id: int, root: str, checkpoint: str, since: float | None = None, once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Start the stream. ``once``: take what is there, then stop."""
    register(spark)
    reader = spark.readStream.format("scan_times")
    times = (reader.option("since", str(since)) if since is not None else reader).load()

    stream = f"{library_id} {checkpoint}"

    def step(batch: DataFrame, number: int) -> None:
        span = None if catalog.taken(stream) >= number else batch.first()
        if span is not None:
            with temporary():
                files = checkpointed(scan_headers(spark, root, span["since"], span["until"]))
                if not files.isEmpty():
                    take(files, number)

    def take(files: DataFrame, number: int) -> None:
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        version = catalog.version("image_files") or None
        plan = ingest(catalog.read("image_files", version, [library_id]), files, library_id, now, catalog.top_id())
        kept = None if plan.changed.isEmpty() else plan.kept
        catalog.add_images(plan.added, library_id, kept, version, stream, number)
        catalog.write("libraries", scanned_at(catalog.read("libraries"), library_id, now))

    writer = times.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
