"""Local outlier factors (Breunig et al., 2000) of one column: in one dimension neighbours are near in sorted order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S

NEIGHBOURS = 20
LEAST_ROWS = 10
#: Places in sorted order that one group of rows has.
CHUNK = 10_000


def lof_df(df: DataFrame, column: str, neighbours: int = NEIGHBOURS, chunk: int = CHUNK) -> DataFrame:
    """(value, lof) of each non-null value, k = min(neighbours, n - 1) nearest by distance, then by place in sorted order.

    The k nearest of a value stand among the k before and the k after it in
    sorted order. Places come from value counts and ranks; chunks of places,
    each with the k places on either side, are worked on alone.
    """
    values = C.normalised(df).select(C.quoted(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    last = F.col("before") + F.col("n") - 1
    # a value's places in steps of a chunk first, so that a frequent value makes no long array
    steps = S.ranked(values).select("v", last.alias("last"), F.explode(F.sequence(F.col("before"), last, F.lit(chunk).cast("long"))).alias("i"))
    rows = steps.select("v", F.explode(F.sequence("i", F.least(F.col("i") + chunk - 1, F.col("last")))).alias("i"))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    own = F.floor(F.col("i") / chunk)
    also = F.array_distinct(F.array(own, F.floor((F.col("i") - neighbours) / chunk), F.floor((F.col("i") + neighbours) / chunk)))
    near = Window.partitionBy("chunk").orderBy("i").rowsBetween(-neighbours, neighbours)
    rows = rows.withColumn("own", own).withColumn("chunk", F.explode(also)).withColumn("around", F.collect_list(F.struct("i", "v")).over(near)).where("chunk = own").select("i", "v", "around")
    away = F.transform(F.filter("around", lambda x: x["i"] != F.col("i")), lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["i"].alias("j")))
    k = F.least(F.lit(neighbours), F.col("total") - 1).cast("int")
    rows = rows.crossJoin(F.broadcast(total)).withColumn("nearest", F.slice(F.array_sort(away), F.lit(1), F.greatest(k, F.lit(0)))).drop("around", "total")
    rows = rows.withColumn("reach", F.try_element_at("nearest", F.lit(-1))["d"])
    links = rows.select("i", F.explode("nearest").alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.d").alias("d"))
    dense = links.join(rows.select(F.col("i").alias("j"), "reach"), "j").groupBy("i").agg(F.avg(F.greatest("d", "reach")).alias("mean"))
    dense = dense.select("i", (1.0 / (F.col("mean") + 1e-10)).alias("density"))
    other = links.select("i", "j").join(dense.select(F.col("i").alias("j"), F.col("density").alias("other")), "j").groupBy("i").agg(F.avg("other").alias("other"))
    return rows.select("i", "v").join(dense, "i").join(other, "i").select(F.col("v").alias("value"), (F.col("other") / F.col("density")).alias("lof"))


def univariate(df: DataFrame, column: str, contamination: float = 0.05) -> dict[str, Any]:
    rows = lof_df(df, column)
    got = rows.agg(F.count("*"), F.percentile("lof", F.lit(1 - contamination))).first()
    out = {"column_name": column, "n": got[0], "outlier_count": 0, "outlier_ratio": 0.0, "extreme_count": 0, "method": "lof", "n_neighbors": max(0, min(NEIGHBOURS, got[0] - 1))}
    if got[0] >= LEAST_ROWS:
        n = rows.where(F.col("lof") > got[1]).count()
        out |= {"outlier_count": n, "outlier_ratio": n / got[0]}
    return out
