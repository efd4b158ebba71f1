"""Profiles: column, numeric, categorical, temporal and boolean summaries, distributions and structural flags.

Every *_df function is one lazy plan; statistics of all columns are fused into
one aggregate over one scan.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S

BINS = 20
#: Distinct counts that one aggregate takes; each expands the rows once.
DISTINCT_BATCH = 8


def quartiles(v: Column, approximate: bool = False) -> Column:
    """Interpolated quartiles; approximate keeps a bounded sketch instead of all distinct values."""
    points = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return F.percentile_approx(v, points, 10_000) if approximate else F.percentile(v, points)


def numeric_summary_df(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, count, mean, std, min, q1, median, q3, max, skewness, kurtosis, range, iqr, cv, zeros_count, negatives_count)."""
    df = C.normalised(df)
    names = [c for c in columns or C.numeric(df) if c in C.numeric(df)]
    aggs = []
    for i, c in enumerate(names):
        v = C.quoted(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), quartiles(v, approximate).alias(f"q{i}"), F.skewness(v).alias(f"g{i}"), F.kurtosis(v).alias(f"k{i}"), F.count_if(v == 0).alias(f"z{i}"), F.count_if(v < 0).alias(f"m{i}")]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, count long, mean double, std double, min double, q1 double, median double, q3 double, max double, skewness double, kurtosis double, `range` double, iqr double, cv double, zeros_count long, negatives_count long")
    rows = []
    for i, c in enumerate(names):
        x = lambda k, i=i: F.col(f"{k}{i}")
        q = lambda k, i=i: F.get(F.col(f"q{i}"), F.lit(k))
        rows.append({
            "column_name": F.lit(c), "count": x("n"), "mean": x("a"), "std": x("s"), "min": x("l"), "q1": q(0), "median": q(1), "q3": q(2), "max": x("h"), "skewness": S.skew(x("n"), x("g")), "kurtosis": S.kurt(x("n"), x("k")),
            "range": x("h") - x("l"), "iqr": q(2) - q(0), "cv": F.try_divide(x("s"), F.nullif(x("a"), F.lit(0.0))), "zeros_count": x("z"), "negatives_count": x("m"),
        })
    return C.unfolded(df.agg(*aggs), rows)


def _batched(df: DataFrame, names: list[str]) -> list[list[str]]:
    return [names[i : i + DISTINCT_BATCH] for i in range(0, len(names), DISTINCT_BATCH)]


def distinct_counts_df(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column_name, distinct) without nulls; exact in batches of a few columns a scan, or sketched in one."""
    if approximate:
        totals = df.agg(*(F.approx_count_distinct(C.quoted(c), 0.01).alias(f"d{i}") for i, c in enumerate(columns)))
        return C.unfolded(totals, [{"column_name": F.lit(c), "distinct": F.col(f"d{i}")} for i, c in enumerate(columns)])
    out = None
    for batch in _batched(df, columns):
        totals = df.agg(*(F.count_distinct(C.quoted(c)).alias(f"d{i}") for i, c in enumerate(batch)))
        part = C.unfolded(totals, [{"column_name": F.lit(c), "distinct": F.col(f"d{i}")} for i, c in enumerate(batch)])
        out = part if out is None else out.union(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "column_name string, distinct long")


def column_summary_df(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, dtype, non_null_count, null_count, null_percentage, unique_count, is_constant, is_highly_null, mean, std, min, max) of every plain column; the last four for numbers and booleans."""
    df = C.normalised(df)
    names = [c for c in columns or df.columns if c in df.columns]
    kinds, numbers = dict(df.dtypes), set(C.numeric(df, True))
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        v = C.quoted(c)
        n = v.cast("int").cast("double") if kinds[c] == "boolean" else v.cast("double") if c in numbers else None
        aggs.append(F.count(v).alias(f"n{i}"))
        if n is not None:
            aggs += [F.avg(n).alias(f"a{i}"), F.stddev_samp(n).alias(f"s{i}"), F.min(n).alias(f"l{i}"), F.max(n).alias(f"h{i}")]
    rows = []
    for i, c in enumerate(names):
        nulls = F.col("rows") - F.col(f"n{i}")
        extra = {k: F.col(f"{x}{i}") if c in numbers else F.lit(None).cast("double") for k, x in (("mean", "a"), ("std", "s"), ("min", "l"), ("max", "h"))}
        extra["mean"], extra["std"] = F.round(extra["mean"], 4), F.round(extra["std"], 4)
        rows.append({"column_name": F.lit(c), "dtype": F.lit(kinds[c]), "non_null_count": F.col(f"n{i}"), "null_count": nulls, "null_percentage": F.round(F.coalesce(F.try_divide(100.0 * nulls, F.col("rows")), F.lit(0.0)), 2), **extra})
    out = C.unfolded(df.agg(*aggs), rows).join(F.broadcast(distinct_counts_df(df, names)), "column_name")
    return out.select("column_name", "dtype", "non_null_count", "null_count", "null_percentage", F.col("distinct").alias("unique_count"), (F.col("distinct") <= 1).alias("is_constant"), (F.col("null_percentage") > 50).alias("is_highly_null"), "mean", "std", "min", "max")


def categorical_summary_df(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, unique_count, mode, mode_frequency, avg_length, max_length, empty_strings, whitespace_only, entropy) of text columns; the least mode of equals."""
    names = [c for c in columns or C.text(df) if c in C.text(df)]
    f = S.frequencies(df, names)
    n, v = F.col("n"), F.col("value")
    return f.groupBy("column_name").agg(
        F.count("*").alias("unique_count"),
        F.min_by("value", F.struct(-n, v)).alias("mode"),
        F.max(n).alias("mode_frequency"),
        (F.sum(F.length(v) * n) / F.sum(n)).alias("avg_length"),
        F.max(F.length(v)).cast("long").alias("max_length"),
        F.coalesce(F.sum(F.when(v == "", n)), F.lit(0)).alias("empty_strings"),
        F.coalesce(F.sum(F.when(v.rlike(r"^\s+$"), n)), F.lit(0)).alias("whitespace_only"),
        F.when(F.count("*") > 1, F.log2(F.sum(n.cast("double"))) - F.sum(n * F.log2(n.cast("double"))) / F.sum(n)).otherwise(0.0).alias("entropy"),
    )


def top_categories_df(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """(value, n, percentage, place): the k most frequent values, equals by value."""
    f = S.frequencies(df, [column])
    total = f.agg(F.sum("n").alias("total"))
    top = f.orderBy(F.desc("n"), "value").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "value"))  # over k rows
    return top.withColumn("place", place).crossJoin(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("percentage"), F.col("place").cast("long").alias("place"))


def datetime_summary_df(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, count, min, max, range_days, most_common_year, most_common_month, weekend_ratio); whole days of 24 hours, the least year and month of equals."""
    names = [c for c in columns or C.temporal(df) if c in C.temporal(df)]
    aggs, rows = [], []
    for i, c in enumerate(names):
        v = C.quoted(c).cast("timestamp_ntz")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.mode(F.year(v), True).alias(f"y{i}"), F.mode(F.month(v), True).alias(f"m{i}"), F.avg((F.weekday(v) >= 5).cast("double")).alias(f"w{i}")]
        x = lambda k, i=i: F.col(f"{k}{i}")
        rows.append({"column_name": F.lit(c), "count": x("n"), "min": x("l"), "max": x("h"), "range_days": F.expr(f"timestampdiff(DAY, l{i}, h{i})"), "most_common_year": x("y"), "most_common_month": x("m"), "weekend_ratio": x("w")})
    return C.unfolded(df.agg(*aggs), rows) if rows else df.sparkSession.createDataFrame([], "column_name string, count long, min timestamp_ntz, max timestamp_ntz, range_days long, most_common_year int, most_common_month int, weekend_ratio double")


def boolean_columns(df: DataFrame) -> list[str]:
    """Boolean columns; if there are none, numbers that are only 0 and 1 (or only null). One pass decides for all."""
    if names := C.boolean(df):
        return names
    names = C.numeric(df)
    if not names:
        return []
    found = df.agg(*(F.count_if(~C.quoted(c).isin(0, 1)).alias(f"x{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if found[i] == 0]


def boolean_summary_df(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, true_count, false_count, true_ratio)."""
    df = C.normalised(df)
    names = columns or boolean_columns(df)
    aggs, rows = [], []
    for i, c in enumerate(names):
        v = C.quoted(c).cast("double") if dict(df.dtypes)[c] != "boolean" else C.quoted(c).cast("int").cast("double")
        aggs += [F.count_if(v == 1).alias(f"t{i}"), F.count_if(v == 0).alias(f"f{i}")]
        rows.append({"column_name": F.lit(c), "true_count": F.col(f"t{i}"), "false_count": F.col(f"f{i}"), "true_ratio": F.coalesce(F.try_divide(F.col(f"t{i}"), F.col(f"t{i}") + F.col(f"f{i}")), F.lit(0.0))})
    return C.unfolded(df.agg(*aggs), rows) if rows else df.sparkSession.createDataFrame([], "column_name string, true_count long, false_count long, true_ratio double")


def distribution_df(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, distribution_type, skewness, kurtosis, normality_p, is_normal) of numeric columns with 3 values or more."""
    df = C.normalised(df)
    names = [c for c in columns or C.numeric(df) if c in C.numeric(df)]
    aggs, rows = [], []
    for i, c in enumerate(names):
        v = C.quoted(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"g{i}"), F.kurtosis(v).alias(f"k{i}")]
        n, g, k = F.col(f"n{i}"), F.col(f"g{i}"), F.col(f"k{i}")
        sk = S.skew(n, g)
        side = F.when(sk > 0, "right").otherwise("left")
        label = F.when(F.abs(sk) > 2, F.concat(F.lit("highly_skewed_"), side)).when(F.abs(sk) > 1, F.concat(F.lit("moderately_skewed_"), side)).otherwise("normal")
        p = S.normal_p(n, g, k)
        rows.append({"column_name": F.lit(c), "n": n, "distribution_type": label, "skewness": sk, "kurtosis": S.kurt(n, k), "normality_p": p, "is_normal": F.coalesce(p > 0.05, F.lit(False))})
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, distribution_type string, skewness double, kurtosis double, normality_p double, is_normal boolean")
    return C.unfolded(df.agg(*aggs), rows).where("n >= 3").drop("n")


def histogram_df(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n): equal widths from least to greatest, the last bin closed; a constant gets half a unit on either side."""
    v = C.quoted(column).cast("double")
    values = C.normalised(df).select(v.alias("v")).where("v is not null")
    bounds = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    flat = F.col("a") == F.col("b")
    bounds = bounds.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    counts = values.crossJoin(F.broadcast(bounds)).groupBy(F.least(F.width_bucket("v", "a", "b", F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    width = (F.col("b") - F.col("a")) / bins
    return every.join(counts, "bin", "left").select(F.col("bin").cast("long").alias("bin"), (F.col("a") + width * (F.col("bin") - 1)).alias("low"), (F.col("a") + width * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def memory_df(df: DataFrame) -> DataFrame:
    """(column_name, bytes): the width of fixed types and the octets of text, summed."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    names = [c for c in df.columns if c not in C.complex_(df)]
    kinds = dict(df.dtypes)
    size = lambda c: F.coalesce(F.sum(F.octet_length(C.quoted(c))), F.lit(0)) if kinds[c] in ("string",) else F.count("*") * width.get(kinds[c], 8)
    totals = df.agg(*(size(c).alias(f"b{i}") for i, c in enumerate(names)))
    return C.unfolded(totals, [{"column_name": F.lit(c), "bytes": F.col(f"b{i}").cast("long")} for i, c in enumerate(names)])


def _falls(df: DataFrame, order_by: str, numbers: list[str], buckets: int = 1024) -> DataFrame:
    """(column_name, falls): how often a number is less than the one before it in the order of a key.

    Keys that are numbers or times fall into buckets of equal width, each with
    a window of its own; bucket ends are compared in a window over the
    buckets. Keys of other types have but one bucket.
    """
    key = C.quoted(order_by)
    kind = dict(df.dtypes)[order_by]
    place = key.cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else key.cast("double") if order_by in numbers else F.lit(0.0)
    rows = df.select(key.alias("key"), place.alias("place"), *(C.quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)))
    bounds = rows.agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("place") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    over, ends = Window.partitionBy("bucket").orderBy("key"), Window.orderBy("bucket")
    inner = rows.select("bucket", "key", *(F.col(f"v{i}") for i in range(len(numbers))), *((F.col(f"v{i}") < F.lag(f"v{i}").over(over)).cast("int").alias(f"f{i}") for i in range(len(numbers))))
    edges = inner.groupBy("bucket").agg(*(F.sum(f"f{i}").alias(f"f{i}") for i in range(len(numbers))), *(F.min_by(f"v{i}", "key").alias(f"a{i}") for i in range(len(numbers))), *(F.max_by(f"v{i}", "key").alias(f"z{i}") for i in range(len(numbers))))
    total = edges.select(*((F.coalesce(F.col(f"f{i}"), F.lit(0)) + F.coalesce((F.col(f"a{i}") < F.lag(f"z{i}").over(ends)).cast("int"), F.lit(0))).alias(f"f{i}") for i in range(len(numbers)))).agg(*(F.sum(f"f{i}").alias(f"f{i}") for i in range(len(numbers))))
    return C.unfolded(total, [{"column_name": F.lit(c), "falls": F.col(f"f{i}")} for i, c in enumerate(numbers)])


def structural_flags_df(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(column_name, is_empty, is_constant, is_mostly_missing, is_index_like). An index-like number has no two equal values and, where order_by names the row order, never falls along it."""
    clean = C.normalised(df)
    names, numbers = clean.columns, C.numeric(clean)
    totals = clean.agg(F.count("*").alias("rows"), *(F.count(C.quoted(c)).alias(f"n{i}") for i, c in enumerate(names)))
    rows = [{"column_name": F.lit(c), "rows": F.col("rows"), "n": F.col(f"n{i}"), "number": F.lit(c in numbers)} for i, c in enumerate(names)]
    out = C.unfolded(totals, rows).join(F.broadcast(distinct_counts_df(clean, names)), "column_name")
    falls = F.lit(0)
    if order_by and numbers:
        sums = _falls(clean, order_by, numbers)
        out = out.join(F.broadcast(sums), "column_name", "left")
        falls = F.coalesce("falls", F.lit(0))
    return out.select("column_name", (F.col("n") == 0).alias("is_empty"), (F.col("distinct") <= 1).alias("is_constant"), (F.col("rows") - F.col("n") > 0.8 * F.col("rows")).alias("is_mostly_missing"), (F.col("number") & (F.col("rows") > 0) & (F.col("distinct") == F.col("rows")) & (falls == 0)).alias("is_index_like"))


class DataProfiler:
    """profile(df) collects all summaries into one dict; nothing but summaries reaches the driver."""

    def __init__(self, max_categories: int = 50, skewness_threshold: float = 2.0) -> None:
        self.max_categories = max_categories
        self.skewness_threshold = skewness_threshold

    def profile(self, df: DataFrame) -> dict[str, Any]:
        total = df.count() if df.columns else 0
        if not total:
            return {"error": "the data has no rows or no columns"}
        by = lambda frame: {r["column_name"]: {k: v for k, v in r.asDict().items() if k != "column_name"} for r in frame.collect()}
        clean = C.normalised(df)
        memory = {r["column_name"]: r["bytes"] for r in memory_df(clean).collect()}
        numeric = by(numeric_summary_df(clean))
        for r in S.entropies(clean, list(numeric)).collect() if numeric else []:
            numeric[r["column_name"]]["entropy"] = r["entropy"]
        categorical = by(categorical_summary_df(clean)) if C.text(clean) else {}
        for c, entry in categorical.items():
            top = top_categories_df(clean, c, self.max_categories).collect()
            entry["top_categories"] = {r["value"]: r["n"] for r in top}
            entry["category_distribution"] = {r["value"]: round(r["percentage"], 2) for r in top[:10]}
        shapes = by(distribution_df(clean))
        for c, entry in shapes.items():
            rows = histogram_df(clean, c).orderBy("bin").collect()
            entry["histogram_bins"] = {"counts": [r["n"] for r in rows], "bin_edges": [rows[0]["low"], *(r["high"] for r in rows)] if rows else []}
        names = [c.lower() for c in df.columns]
        flags = by(structural_flags_df(clean))
        chosen = lambda k: [c for c, f in flags.items() if f[k]]
        return {
            "dataset_shape": (total, len(df.columns)),
            "total_cells": total * len(df.columns),
            "memory_usage": {"total_bytes": sum(memory.values()), "total_mb": round(sum(memory.values()) / 2**20, 4), "per_column": memory, "per_row_bytes": sum(memory.values()) / total},
            "column_summary": by(column_summary_df(clean)),
            "numeric_summary": numeric,
            "categorical_summary": categorical,
            "datetime_summary": by(datetime_summary_df(clean)),
            "boolean_summary": by(boolean_summary_df(clean)),
            "distributions": shapes,
            "structural_flags": {"empty_columns": chosen("is_empty"), "constant_columns": chosen("is_constant"), "duplicate_column_names": sorted({c for c in names if names.count(c) > 1}), "mostly_missing_columns": chosen("is_mostly_missing"), "index_like_columns": chosen("is_index_like"), "mixed_type_columns": []},
        }

    def get_column_stats(self, df: DataFrame, column: str) -> dict[str, Any]:
        """One column's statistics, variance for numbers included."""
        if column not in df.columns:
            return {"error": f"there is no column {column!r}"}
        one = C.normalised(df.select(C.quoted(column)))
        if not one.columns:
            return {"error": f"column {column!r} has a complex type"}
        out = {k: v for k, v in column_summary_df(one).first().asDict().items() if k != "column_name"}
        if C.numeric(one):
            out |= {k: v for k, v in numeric_summary_df(one).first().asDict().items() if k != "column_name"}
            out["variance"] = None if out["std"] is None else out["std"] ** 2
            out["entropy"] = S.entropies(one, [column]).first()["entropy"]
        return out
