"""Running statistics of numeric columns over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C


def stream_profile(stream: DataFrame, columns: list[str] | None = None, time: str | None = None, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(column_name, rows, count, null_count, mean, std, min, max), and window where time names an event time.

    Without time the query runs in complete mode. With it, windows of `every`
    close once the watermark, `late` behind the greatest time seen, is past.
    """
    rows = C.normalised(stream)
    names = [c for c in columns or C.numeric(rows) if c in C.numeric(rows)]
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), C.quoted(c).cast("double").alias("v")) for c in names))
    keys = []
    if time:
        rows = rows.withWatermark(time, late)
        keys = [F.window(C.quoted(time), every).alias("window")]
        rows = rows.select(C.quoted(time), F.inline(cells))
    else:
        rows = rows.select(F.inline(cells))
    v = F.col("v")
    return rows.groupBy(*keys, "column_name").agg(F.count("*").alias("rows"), F.count(v).alias("count"), (F.count("*") - F.count(v)).alias("null_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
