"""Missing values: counts, severities, patterns, strategies and what deletion would cost."""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S
from edascope.types import MissingValueReport

# Texts that stand for a missing value.
SENTINELS = ["", " ", "NA", "N/A", "n/a", "null", "NULL", "None", "?", "-"]


def without_sentinels(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    """df with NaN, and in text columns the sentinels, as null."""
    clean, words = C.normalised(df), [*SENTINELS, *(more or [])]
    texts = set(C.text(clean))
    return clean.select(*(F.when(~C.quoted(c).isin(words), C.quoted(c)).alias(c) if c in texts else C.quoted(c) for c in clean.columns))


def missing_by_column_df(df: DataFrame, sentinels: list[str] | None = None) -> DataFrame:
    """(column_name, null_count, null_ratio, non_null_count, severity, suggested_strategy, mean, median, std) of columns with nulls; one scan."""
    clean = without_sentinels(df, sentinels)
    numbers, times = C.numeric(clean), C.temporal(clean)
    aggs, rows = [F.count("*").alias("rows")], []
    for i, c in enumerate(clean.columns):
        v = C.quoted(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in numbers:
            x = v.cast("double")
            aggs += [F.avg(x).alias(f"a{i}"), F.percentile(x, F.lit(0.5)).alias(f"q{i}"), F.stddev_samp(x).alias(f"s{i}")]
        kind = "number" if c in numbers else "time" if c in times else "other"
        get = lambda k, c=c, i=i: F.col(f"{k}{i}") if c in numbers else F.lit(None).cast("double")
        rows.append({"column_name": F.lit(c), "rows": F.col("rows"), "n": F.col(f"n{i}"), "kind": F.lit(kind), "mean": get("a"), "median": get("q"), "std": get("s")})
    out = C.unfolded(clean.agg(*aggs), rows).where("n < rows")
    nulls = F.col("rows") - F.col("n")
    ratio = nulls / F.col("rows")
    # a signed ratio, so that a negative mean always gives `mean`; one value has no deviation and gives `median`
    steady = F.coalesce((F.col("mean") != 0) & (F.try_divide(F.col("std"), F.nullif("mean", F.lit(0.0))) < 0.1), F.lit(False))
    strategy = F.when((F.col("kind") == "number") & (F.col("n") == 0), "drop_column").when((F.col("kind") == "number") & steady, "mean").when(F.col("kind") == "number", "median").when(F.col("kind") == "time", "interpolate").otherwise("mode")
    return out.select("column_name", nulls.alias("null_count"), F.round(ratio, 6).alias("null_ratio"), F.col("n").alias("non_null_count"), S.severity(ratio).alias("severity"), strategy.alias("suggested_strategy"), "mean", "median", "std")


def missing_patterns_df(df: DataFrame, top: int = 10, sentinels: list[str] | None = None) -> DataFrame:
    """(missing_columns, row_count, percentage): the most frequent sets of columns that are null together."""
    clean = without_sentinels(df, sentinels)
    pattern = F.array_join(F.array_compact(F.array(*(F.when(C.quoted(c).isNull(), F.lit(c)) for c in clean.columns))), ", ")
    counts = clean.groupBy(pattern.alias("missing_columns")).agg(F.count("*").alias("row_count"))
    total = clean.agg(F.count("*").alias("total"))
    return counts.where("missing_columns <> ''").crossJoin(F.broadcast(total)).select("missing_columns", "row_count", F.round(100.0 * F.col("row_count") / F.col("total"), 2).alias("percentage")).orderBy(F.desc("row_count"), "missing_columns").limit(top)


def _nulls(df: DataFrame) -> Column:
    total = F.lit(0)
    for c in df.columns:
        total = total + C.quoted(c).isNull().cast("int")
    return total


def row_null_counts_df(df: DataFrame, sentinels: list[str] | None = None) -> DataFrame:
    """(null_cells, row_count): rows by how many of their cells are null."""
    clean = without_sentinels(df, sentinels)
    return clean.groupBy(_nulls(clean).cast("long").alias("null_cells")).agg(F.count("*").alias("row_count"))


def nullity_correlation_df(df: DataFrame, sentinels: list[str] | None = None) -> DataFrame:
    """(column_1, column_2, correlation) of null indicators, each pair of columns once; one scan."""
    clean = without_sentinels(df, sentinels)
    pairs = list(combinations(clean.columns, 2))
    flag = lambda c: C.quoted(c).isNull().cast("int").cast("double")
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_1 string, column_2 string, correlation double")
    totals = clean.agg(*(S.covariance_ratio(flag(a), flag(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return C.unfolded(totals, [{"column_1": F.lit(a), "column_2": F.lit(b), "correlation": F.col(f"r{i}")} for i, (a, b) in enumerate(pairs)])


def deletion_impact_df(df: DataFrame, strategy: str = "row") -> DataFrame:
    """What dropping rows, or columns, with nulls leaves: (strategy, original, remaining, dropped, retention_ratio, data_loss_percentage) for rows; for columns the last is dropped_column_names."""
    clean = C.normalised(df)
    if strategy == "row":
        full = F.lit(True)
        for c in clean.columns:
            full = full & C.quoted(c).isNotNull()
        totals = clean.agg(F.count("*").alias("n"), F.count_if(full).alias("k"))
        share = F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("n")), F.lit(0.0))
        return totals.select(F.lit("row").alias("strategy"), F.col("n").alias("original_rows"), F.col("k").alias("remaining_rows"), (F.col("n") - F.col("k")).alias("dropped_rows"), F.round(share, 4).alias("retention_ratio"), F.round(100.0 * (1 - share), 2).alias("data_loss_percentage"))
    totals = clean.agg(F.count("*").alias("n"), *(F.count(C.quoted(c)).alias(f"c{i}") for i, c in enumerate(clean.columns)))
    gone = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"c{i}") < F.col("n"), F.lit(c)) for i, c in enumerate(clean.columns)))))
    width = len(clean.columns)
    return totals.select(F.lit("column").alias("strategy"), F.lit(width).cast("long").alias("original_columns"), (F.lit(width) - F.size(gone)).cast("long").alias("remaining_columns"), F.size(gone).cast("long").alias("dropped_columns"), F.round((F.lit(width) - F.size(gone)) / F.lit(float(max(width, 1))), 4).alias("retention_ratio"), F.array_join(gone, ", ").alias("dropped_column_names"))


class MissingValueAnalyzer:
    def __init__(self, missing_indicators: list[str] | None = None) -> None:
        self.missing_indicators = list(missing_indicators or [])

    def analyze(self, df: DataFrame) -> MissingValueReport:
        if not df.columns or df.isEmpty():
            return MissingValueReport()
        clean = without_sentinels(df, self.missing_indicators)
        total, width = clean.count(), len(clean.columns)
        rows = missing_by_column_df(df, self.missing_indicators).collect()
        report = MissingValueReport(total_missing=sum(r["null_count"] for r in rows), total_cells=total * width)
        report.overall_missing_ratio = round(report.total_missing / report.total_cells, 6) if report.total_cells else 0.0
        for r in rows:
            entry = {k: v for k, v in r.asDict().items() if k != "column_name"}
            report.column_missing[r["column_name"]] = entry if entry["mean"] is not None else {k: v for k, v in entry.items() if k not in ("mean", "median", "std")}
        report.columns_with_missing = list(report.column_missing)
        report.completely_empty_columns = [c for c, e in report.column_missing.items() if e["non_null_count"] == 0]
        report.missing_patterns = [{**r.asDict(), "missing_columns": r["missing_columns"].split(", ")} for r in missing_patterns_df(df, sentinels=self.missing_indicators).collect()]
        report.recommendations = self._advice(report, clean, total)
        return report

    def _advice(self, report: MissingValueReport, clean: DataFrame, total: int) -> list[str]:
        if not report.total_missing:
            return ["No missing values were found."]
        out, share = [], report.overall_missing_ratio
        if share > 0.3:
            out.append(f"CRITICAL: {share:.1%} of all cells are missing; look at how the data is gathered.")
        elif share > 0.1:
            out.append(f"WARNING: {share:.1%} of all cells are missing.")
        drop = [c for c, e in report.column_missing.items() if e["severity"] == "critical"]
        if drop:
            out.append(f"Think of dropping columns that are at least half empty: {', '.join(drop)}.")
        groups: dict[str, list[str]] = {}
        for c, e in report.column_missing.items():
            if e["severity"] in ("high", "moderate"):
                groups.setdefault(e["suggested_strategy"], []).append(c)
        out += [f"Impute by {how}: {', '.join(names)}." for how, names in groups.items()]
        sparse = clean.where(_nulls(clean) > 0.5 * len(clean.columns)).count()
        if sparse:
            out.append(f"{sparse} of {total} rows are more than half empty.")
        if len(report.columns_with_missing) > 1:
            linked = nullity_correlation_df(clean.select(*map(C.quoted, report.columns_with_missing))).where("abs(correlation) > 0.7").count()
            if linked:
                out.append(f"Values go missing together in {linked} pairs of columns; they may not be missing at random.")
        return out

    def get_deletion_impact(self, df: DataFrame, strategy: str = "row") -> dict[str, Any]:
        out = deletion_impact_df(df, strategy).first().asDict()
        if "dropped_column_names" in out:
            out["dropped_column_names"] = [c for c in out["dropped_column_names"].split(", ") if c]
        return out
