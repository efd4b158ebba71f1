"""Outliers: by quartiles, z-scores, median deviations, isolation forests and local outlier factors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.operators import forest, lof
from edascope.types import OutlierMethod, OutlierReport

#: Scales a median deviation to a standard deviation.
MAD_SCALE = 0.6745
MOST_INDICES = 1000


def _values(df: DataFrame, columns: list[str] | None) -> tuple[DataFrame, list[str]]:
    clean = C.normalised(df)
    numbers = C.numeric(clean)
    return clean, [c for c in columns if c in numbers] if columns else numbers


def bounds_df(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: count, quartiles, mean, deviation and median of every column, from one scan."""
    clean, names = _values(df, columns)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        v = C.quoted(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
    return clean.agg(*aggs)


def _masks(method: str, v: Column, i: int, k: float, z: float) -> tuple[Column, Column, dict[str, Column]]:
    """Whether v is an outlier, an extreme one, and the bounds, over the columns of a bounds row (and m{i}, the median deviation)."""
    q = lambda j: F.get(F.col(f"q{i}"), F.lit(j))
    if method == OutlierMethod.ZSCORE.value:
        score = F.try_divide(F.abs(v - F.col(f"a{i}")), F.nullif(f"s{i}", F.lit(0.0)))
        return score > z, score > 1.5 * z, {"mean": F.col(f"a{i}"), "std": F.col(f"s{i}")}
    if method == OutlierMethod.MODIFIED_ZSCORE.value:
        score = F.try_divide(MAD_SCALE * F.abs(v - q(1)), F.nullif(f"m{i}", F.lit(0.0)))
        return score > z, score > 1.5 * z, {"median": q(1), "mad": F.col(f"m{i}")}
    iqr = q(2) - q(0)
    low, high = q(0) - k * iqr, q(2) + k * iqr
    return (v < low) | (v > high), (v < q(0) - 3 * iqr) | (v > q(2) + 3 * iqr), {"q1": q(0), "q3": q(2), "iqr": iqr, "lower": low, "upper": high, "extreme_lower": q(0) - 3 * iqr, "extreme_upper": q(2) + 3 * iqr}


def outliers_df(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", k: float = 1.5, z: float = 3.0) -> DataFrame:
    """(column_name, n, outlier_count, outlier_ratio, extreme_count, bounds...) of numeric columns with 3 values or more.

    Two scans whatever the number of columns (three for median deviations):
    one for the bounds, one row that is broadcast, and one that counts.
    """
    clean, names = _values(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n long, outlier_count long, outlier_ratio double, extreme_count long")
    bounds = bounds_df(df, names)
    values = clean.select(*(C.quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    if method == OutlierMethod.MODIFIED_ZSCORE.value:
        away = values.crossJoin(F.broadcast(bounds)).agg(*(F.percentile(F.abs(F.col(f"v{i}") - F.get(f"q{i}", F.lit(1))), F.lit(0.5)).alias(f"m{i}") for i in range(len(names))))
        bounds = bounds.crossJoin(F.broadcast(away))
    aggs, rows = [], []
    for i, c in enumerate(names):
        out, extreme, shown = _masks(method, F.col(f"v{i}"), i, k, z)
        aggs += [F.count_if(out).alias(f"o{i}"), F.count_if(extreme).alias(f"e{i}"), F.first(f"n{i}").alias(f"n{i}"), *(F.first(b).alias(f"{name}{i}") for name, b in shown.items())]
        rows.append({"column_name": F.lit(c), "n": F.col(f"n{i}"), "outlier_count": F.col(f"o{i}"), "outlier_ratio": F.coalesce(F.try_divide(F.col(f"o{i}").cast("double"), F.col(f"n{i}")), F.lit(0.0)), "extreme_count": F.col(f"e{i}"), **{name: F.col(f"{name}{i}") for name in shown}})
    return C.unfolded(values.crossJoin(F.broadcast(bounds)).agg(*aggs), rows).where("n >= 3")


def outlier_rows_df(df: DataFrame, column: str, method: str = "iqr", k: float = 1.5, z: float = 3.0) -> DataFrame:
    """The rows of df whose value is an outlier by quartiles, z-score or median deviation; none for other methods or an unknown column."""
    if column not in C.numeric(df) or method not in (OutlierMethod.IQR.value, OutlierMethod.ZSCORE.value, OutlierMethod.MODIFIED_ZSCORE.value):
        return df.limit(0)
    bounds = bounds_df(df, [column])
    v = F.when(~F.isnan(C.quoted(column).cast("double")), C.quoted(column).cast("double"))
    if method == OutlierMethod.MODIFIED_ZSCORE.value:
        away = df.select(v.alias("v")).crossJoin(F.broadcast(bounds)).agg(F.percentile(F.abs(F.col("v") - F.get("q0", F.lit(1))), F.lit(0.5)).alias("m0"))
        bounds = bounds.crossJoin(F.broadcast(away))
    row = df.select(F.struct(*map(C.quoted, df.columns)).alias("__row"), v.alias("__value")).crossJoin(F.broadcast(bounds))
    mask, _, _ = _masks(method, F.col("__value"), 0, k, z)
    return row.where(mask).select("__row.*")


class OutlierAnalyzer:
    def __init__(self, method: OutlierMethod | str = OutlierMethod.IQR, iqr_multiplier: float = 1.5, zscore_threshold: float = 3.0, contamination: float = 0.05, random_state: int = 42, max_rows_for_multivariate: int = 50_000) -> None:
        self.method = OutlierMethod(method)
        self.iqr_multiplier = iqr_multiplier
        self.zscore_threshold = zscore_threshold
        self.contamination = contamination
        self.random_state = random_state
        self.max_rows_for_multivariate = max_rows_for_multivariate

    def analyze(self, df: DataFrame, columns: list[str] | None = None, include_multivariate: bool = False, row_id: str | None = None) -> OutlierReport:
        """row_id names a column of which outlier_indices are taken; without it indices stay empty, since rows of a frame have no number."""
        if not df.columns or df.isEmpty():
            return OutlierReport()
        clean, names = _values(df, columns)
        report = OutlierReport(columns_analyzed=names, method_used=self.method.value, iqr_multiplier=self.iqr_multiplier, zscore_threshold=self.zscore_threshold)
        total = df.count()
        for r in self._found(df, names):
            if r["outlier_count"]:
                shown = {k: v for k, v in r.items() if k not in ("column_name", "n", "outlier_count", "outlier_ratio", "extreme_count")}
                if self.method in (OutlierMethod.ZSCORE, OutlierMethod.MODIFIED_ZSCORE):
                    shown["threshold"] = self.zscore_threshold
                c = r["column_name"]
                report.outliers_by_column[c] = {"outlier_count": r["outlier_count"], "outlier_ratio": round(r["outlier_ratio"], 6), "extreme_count": r["extreme_count"], "bounds": shown, "method": self.method.value}
                if r["extreme_count"]:
                    report.extreme_outliers[c] = r["extreme_count"]
                if row_id and row_id in df.columns:
                    report.outlier_indices[c] = [x[0] for x in self.get_outlier_rows(df, c).select(C.quoted(row_id)).orderBy(C.quoted(row_id)).limit(MOST_INDICES).collect()]
        report.total_outliers = sum(e["outlier_count"] for e in report.outliers_by_column.values())
        report.outlier_ratio = round(report.total_outliers / (total * len(names)), 6) if names and total else 0.0
        if include_multivariate and len(names) >= 2:
            report.multivariate_outliers = forest.multivariate_count(clean.select(*map(C.quoted, names)), self.contamination, self.random_state, self.max_rows_for_multivariate)
        report.recommendations = self._advice(report)
        return report

    def _found(self, df: DataFrame, names: list[str]) -> list[dict[str, Any]]:
        if self.method == OutlierMethod.ISOLATION_FOREST:
            return [forest.univariate(df, c, self.contamination, self.random_state) for c in names]
        if self.method == OutlierMethod.LOF:
            return [lof.univariate(df, c, self.contamination) for c in names]
        return [r.asDict() for r in outliers_df(df, names, self.method.value, self.iqr_multiplier, self.zscore_threshold).collect()]

    def _advice(self, report: OutlierReport) -> list[str]:
        out = [f"Column {c!r} has {e['outlier_ratio']:.1%} outliers; look at how its values come about." for c, e in report.outliers_by_column.items() if e["outlier_ratio"] > 0.05]
        if report.extreme_outliers:
            out.append(f"Extreme values stand in {', '.join(report.extreme_outliers)}; check them first.")
        notes = {OutlierMethod.IQR: "Quartile bounds hold for skewed data too.", OutlierMethod.ZSCORE: "z-scores assume about normal data.", OutlierMethod.ISOLATION_FOREST: "The share of outliers follows the contamination given."}
        if report.outliers_by_column and self.method in notes:
            out.append(notes[self.method])
        if report.multivariate_outliers:
            out.append(f"{report.multivariate_outliers} rows are unusual in several columns together.")
        return out or ["No outliers were found."]

    def get_outlier_rows(self, df: DataFrame, column: str) -> DataFrame:
        return outlier_rows_df(df, column, self.method.value, self.iqr_multiplier, self.zscore_threshold)
