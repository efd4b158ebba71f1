"""Statistics as column expressions; all stay in generated code, none can raise on odd input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edascope.functions.columns import quoted


def skew(n: Column, population: Column) -> Column:
    """Sample skewness from the population's; 0 for a constant, null under 3 values."""
    n = n.cast("double")
    return F.when(n >= 3, F.coalesce(F.sqrt(n * (n - 1)) / (n - 2) * population, F.lit(0.0)))


def kurt(n: Column, population: Column) -> Column:
    """Sample excess kurtosis from the population's; 0 for a constant, null under 4 values."""
    n = n.cast("double")
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6), F.lit(0.0)))


def normal_p(n: Column, g1: Column, g2: Column) -> Column:
    """p of D'Agostino and Pearson's K2 test from population skewness and excess kurtosis; null under 8 values or for a constant."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    z1 = 1 / F.sqrt(0.5 * F.log(w2)) * F.asinh(F.when(y == 0, 1.0).otherwise(y) / F.sqrt(2 / (w2 - 1)))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))
    return F.when((n >= 8) & g1.isNotNull(), F.exp(-(z1 * z1 + z2 * z2) / 2))


def covariance_ratio(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are given; 0 where it is undefined."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.coalesce(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)), F.lit(0.0))


def severity(ratio: Column) -> Column:
    return F.when(ratio >= 0.5, "critical").when(ratio >= 0.2, "high").when(ratio >= 0.05, "moderate").otherwise("low")


def cardinality(ratio: Column, distinct: Column) -> Column:
    return F.when(ratio == 1, "unique").when(ratio > 0.9, "very-high").when(ratio > 0.5, "high").when(distinct <= 10, "low").when(distinct <= 100, "medium").otherwise("high")


def is_lower(v: Column) -> Column:
    return (v == F.lower(v)) & (v != F.upper(v))


def is_upper(v: Column) -> Column:
    return (v == F.upper(v)) & (v != F.lower(v))


def is_title(v: Column) -> Column:
    """Each run of letters starts with a capital and has no other."""
    return v.rlike(r"\p{Lu}") & ~v.rlike(r"\p{L}\p{Lu}") & ~v.rlike(r"(^|[^\p{L}])\p{Ll}")


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): how often each non-null value stands in each column."""
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(parts)).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def entropies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, entropy) in bits, over value frequencies; 0 for one value or none."""
    n = F.col("n").cast("double")
    out = frequencies(df, columns).groupBy("column_name").agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"), F.count("*").alias("distinct"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return named.join(out, "column_name", "left").select("column_name", F.when(F.col("distinct") > 1, F.col("entropy")).otherwise(0.0).alias("entropy"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """(gini): the coefficient of a column's non-null values, from value counts and running sums over distinct values.

    Ranks come from ranked(), so that no task holds the column.
    """
    v = quoted(column).cast("double")
    values = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    placed = ranked(values)
    # ranks r+1..r+n of equal values v: their sum is n r + n (n + 1) / 2
    n, r = F.col("n").cast("double"), F.col("before").cast("double")
    total = placed.agg(F.sum(n).alias("m"), F.sum(n * F.col("v")).alias("s"), F.sum(F.col("v") * (n * r + n * (n + 1) / 2)).alias("w"))
    return total.select(F.when(F.col("s") != 0, 2 * F.col("w") / (F.col("m") * F.col("s")) - (F.col("m") + 1) / F.col("m")).alias("gini"))


def ranked(values: DataFrame, keys: list[str] | None = None, cells: int = 64, parts: int = 16) -> DataFrame:
    """values (keys..., v, n) with before added: how many rows of the same keys have a lesser v.

    Distinct values fall into cells of about equal number, by a sketch's
    quantiles, and each cell's into parts of equal width, so that far values
    don't put the others in one bucket; running sums go over a bucket's values
    and over the few buckets, so no task holds a column.
    """
    keys = keys or []
    cuts = F.percentile_approx("v", F.array(*(F.lit(k / cells) for k in range(1, cells))), F.lit(1000))
    bounds = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), cuts.alias("cuts"))
    placed = values.join(F.broadcast(bounds), keys) if keys else values.crossJoin(F.broadcast(bounds))
    placed = placed.withColumn("cell", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    low = F.coalesce(F.when(F.col("cell") > 0, F.get("cuts", F.col("cell") - 1)), F.col("lo"))
    high = F.coalesce(F.get("cuts", F.col("cell")), F.col("hi"))
    share = F.nanvl(F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0)), F.lit(0.0))
    placed = placed.withColumn("bucket", F.col("cell") * parts + F.least(F.floor(share * parts), F.lit(parts - 1))).drop("lo", "hi", "cuts", "cell")
    sizes = placed.groupBy(*keys, "bucket").agg(F.sum("n").alias("size"))
    below = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("below", below).drop("size")
    upto = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    return placed.withColumn("upto", upto).join(F.broadcast(offsets), [*keys, "bucket"]).withColumn("before", F.col("below") + F.col("upto") - F.col("n")).drop("below", "upto", "bucket")
