"""Integration time by object, and the cut of small slices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import observed
from ..functions.text import nocase
from .timeline import plotted


def integration_by_object(images: DataFrame, begin: dt.datetime, end: dt.datetime, **selection) -> DataFrame:
    """(object_name, hours) of light frames observed between two times, in order.

    Names group without ASCII case; the least name of a group stands for it.
    """

    def time(t):
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")

    df = plotted(images, **selection).where(F.col("object_name").isNotNull() & F.col("exposure").isNotNull() & observed().between(time(begin), time(end)))
    return df.groupBy(nocase("object_name").alias("key")).agg(F.min("object_name").alias("object_name"), (F.sum("exposure") / 3600).alias("hours")).select("object_name", "hours").orderBy("object_name")


def cut_small_slices(slices: DataFrame, percent: float = 2.0, name: str = "object_name", value: str = "hours") -> DataFrame:
    """Slices in name order; one at or below ``percent`` of what is left so far is dropped, which lowers what is left for the next.

    The slices of one pie are folded in order, so they meet in one row: a plot's slices are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.aggregate("all", F.lit(0.0), lambda a, x: a + x["v"]).alias("left"), F.filter("all", lambda x: F.lit(False)).alias("kept"))
    folded = F.aggregate(
        "all",
        start,
        lambda s, x: F.when(x["v"] <= percent / 100 * s["left"], F.struct((s["left"] - x["v"]).alias("left"), s["kept"].alias("kept"))).otherwise(F.struct(s["left"].alias("left"), F.concat(s["kept"], F.array(x)).alias("kept"))),
    )
    return slices.agg(ordered.alias("all")).select(F.inline(folded["kept"]).alias(name, value)).withColumn("label", F.format_string("%.1f", F.col(value)))
