"""Correlations: Pearson, Spearman and Kendall's tau-b over rows where both columns are given."""

from __future__ import annotations

from functools import partial
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S
from edascope.sources.ship import shipped
from edascope.types import CorrelationReport

METHODS = ("pearson", "spearman", "kendall")
PAIRS = "column_1 string, column_2 string, correlation double"


def _pairs_of(names: list[str]) -> list[tuple[str, str]]:
    return list(combinations(names, 2))


def pearson_df(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column_1, column_2, correlation) of each pair; all pairs in one aggregate over one scan."""
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIRS)
    clean = C.normalised(df)
    totals = clean.agg(*(S.covariance_ratio(C.quoted(a).cast("double"), C.quoted(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return C.unfolded(totals, [{"column_1": F.lit(a), "column_2": F.lit(b), "correlation": F.col(f"r{i}")} for i, (a, b) in enumerate(pairs)])


def spearman_df(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson over average ranks, ranks being those among the rows where both are given.

    Ranks belong to values, not rows: value counts, running sums over them,
    and a join back, all pairs together.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIRS)
    clean = C.normalised(df)
    both = F.array(*(F.when(C.quoted(a).isNotNull() & C.quoted(b).isNotNull(), F.struct(F.lit(i).alias("pair"), C.quoted(a).cast("double").alias("x"), C.quoted(b).cast("double").alias("y"))) for i, (a, b) in enumerate(pairs)))
    cells = clean.select(F.inline(F.array_compact(both))).groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    ranks = []
    for side in ("x", "y"):
        values = cells.groupBy("pair", F.col(side).alias("v")).agg(F.sum("n").alias("n"))
        r = S.ranked(values, ["pair"])
        ranks.append(r.select("pair", F.col("v").alias(side), (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{side}")))
    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = cells.join(ranks[0], ["pair", "x"]).join(ranks[1], ["pair", "y"]).groupBy("pair").agg(F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))
    r = F.try_divide(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.sqrt((F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n"))))
    return _named(df, pairs, sums.select("pair", r.alias("r")))


def _apart(boxes: pd.DataFrame, grid: int) -> pd.DataFrame:
    """Concordant less discordant pairs among boxes that differ in both bucket numbers."""
    n = np.zeros((grid, grid))
    np.add.at(n, (boxes["bx"].to_numpy(), boxes["by"].to_numpy()), boxes["n"].to_numpy())
    # of each box, the rows in boxes to its left: all of them by bucket of y, then those below and above
    left = np.zeros_like(n)
    left[1:] = np.cumsum(n, axis=0)[:-1]
    below = np.zeros_like(n)
    below[:, 1:] = np.cumsum(left, axis=1)[:, :-1]
    above = left.sum(axis=1, keepdims=True) - below - left
    return pd.DataFrame({"pair": [boxes["pair"].iloc[0]], "s": [float((n * (below - above)).sum())]})


def kendall_df(df: DataFrame, pairs: list[tuple[str, str]], grid: int = 256) -> DataFrame:
    """Kendall's tau-b, exactly, without pairing all rows.

    Rows are counted in cells of equal values first. A grid of value buckets
    then settles most pairs of cells: those in buckets apart on both axes are
    counted from the grid's sums alone; only cells that share a row or column
    of the grid are compared one with another, about 2 / grid of all pairs.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIRS)
    clean = C.normalised(df)
    both = F.array(*(F.when(C.quoted(a).isNotNull() & C.quoted(b).isNotNull(), F.struct(F.lit(i).alias("pair"), C.quoted(a).cast("double").alias("x"), C.quoted(b).cast("double").alias("y"))) for i, (a, b) in enumerate(pairs)))
    cells = clean.select(F.inline(F.array_compact(both))).groupBy("pair", "x", "y").agg(F.count("*").cast("double").alias("n"))
    for side in ("x", "y"):
        values = cells.groupBy("pair", F.col(side).alias("v")).agg(F.sum("n").cast("long").alias("n"))
        r = S.ranked(values, ["pair"])
        total = values.groupBy("pair").agg(F.sum("n").alias("total"))
        bucket = F.floor(F.col("before") * grid / F.col("total")).alias(f"b{side}")
        cells = cells.join(r.join(F.broadcast(total), "pair").select("pair", F.col("v").alias(side), bucket), ["pair", side])
    # buckets against buckets, from sums over a pair's grid: at most grid^2 numbers
    shipped(df.sparkSession)
    boxes = cells.groupBy("pair", "bx", "by").agg(F.sum("n").alias("n"))
    coarse = boxes.groupBy("pair").applyInPandas(partial(_apart, grid=grid), "pair int, s double")
    # cells in one column of the grid; and cells in one row but not one column
    parts = [coarse]
    for same, also in (("bx", F.lit(True)), ("by", F.col("a.bx") != F.col("b.bx"))):
        near = cells.alias("a").join(cells.alias("b"), (F.col("a.pair") == F.col("b.pair")) & (F.col(f"a.{same}") == F.col(f"b.{same}")) & (F.col("a.x") < F.col("b.x")) & also)
        parts.append(near.groupBy(F.col("a.pair").alias("pair")).agg(F.sum(F.col("a.n") * F.col("b.n") * F.signum(F.col("b.y") - F.col("a.y"))).alias("s")))
    score = parts[0].union(parts[1]).union(parts[2]).groupBy("pair").agg(F.sum("s").alias("s"))
    total = cells.groupBy("pair").agg(F.sum("n").alias("m"))
    ties = []
    for side in ("x", "y"):
        v = cells.groupBy("pair", side).agg(F.sum("n").alias("n"))
        ties.append(v.groupBy("pair").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t{side}")))
    every = F.col("m") * (F.col("m") - 1) / 2
    out = total.join(ties[0], "pair").join(ties[1], "pair").join(score, "pair", "left")
    r = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((every - F.col("tx")) * (every - F.col("ty"))))
    return _named(df, pairs, out.select("pair", r.alias("r")))


def _named(df: DataFrame, pairs: list[tuple[str, str]], found: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_1 string, column_2 string")
    return names.join(found, "pair", "left").select("column_1", "column_2", F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)).alias("correlation"))


def correlation_df(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(column_1, column_2, correlation) of each pair of numeric columns once; 0 where undefined."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    numbers = C.numeric(df)
    names = [c for c in columns if c in numbers] if columns else numbers
    return {"pearson": pearson_df, "spearman": spearman_df, "kendall": kendall_df}[method](df, _pairs_of(names))


def strong_pairs_df(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", high: float = 0.7) -> DataFrame:
    """Pairs of abs(correlation) >= high, the strongest first."""
    r = F.round("correlation", 6)
    out = correlation_df(df, columns, method).where(F.abs("correlation") >= high).select("column_1", "column_2", r.alias("correlation"), F.abs(r).alias("abs_correlation"))
    return out.orderBy(F.desc("abs_correlation"), "column_1", "column_2")


def target_df(df: DataFrame, target: str, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(feature, target, correlation, abs_correlation) of the target with each other numeric column."""
    numbers = C.numeric(df)
    pairs = [(c, target) for c in (columns or numbers) if c in numbers and c != target]
    rows = {"pearson": pearson_df, "spearman": spearman_df, "kendall": kendall_df}[method](df, pairs if target in numbers else [])
    return rows.select(F.col("column_1").alias("feature"), F.col("column_2").alias("target"), F.round("correlation", 6).alias("correlation"), F.round(F.abs("correlation"), 6).alias("abs_correlation"))


class CorrelationAnalyzer:
    def __init__(self, method: str = "pearson", high_threshold: float = 0.7, low_threshold: float = 0.1, min_samples: int = 3) -> None:
        if method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        self.method, self.high_threshold, self.low_threshold, self.min_samples = method, high_threshold, low_threshold, min_samples

    def analyze(self, df: DataFrame, columns: list[str] | None = None, target: str | None = None) -> CorrelationReport:
        if not df.columns or df.isEmpty():
            return CorrelationReport(method=self.method)
        listed = [c for c in (columns or df.columns) if c in C.numeric(df, True)]
        report = CorrelationReport(method=self.method, numeric_columns=listed)
        names = [c for c in listed if c in C.numeric(df)]
        if len(listed) < 2:
            return report
        clean = C.normalised(df)
        counts = clean.agg(*(F.count(C.quoted(c)) for c in names), *(F.count_distinct(C.quoted(c)) for c in names)).first() if names else []
        names_kept = [c for i, c in enumerate(names) if counts[i] >= self.min_samples]
        constant = {c for i, c in enumerate(names) if counts[len(names) + i] <= 1}
        report.correlation_matrix = {a: {b: (0.0 if a in constant else 1.0) if a == b else 0.0 for b in names_kept} for a in names_kept}
        pairs = []
        for r in correlation_df(clean, names_kept, self.method).collect():
            a, b, v = r
            report.correlation_matrix[a][b] = report.correlation_matrix[b][a] = v
            pairs.append({"column_1": a, "column_2": b, "correlation": round(v, 6), "abs_correlation": round(abs(v), 6), "raw": abs(v)})
        strong = sorted((p for p in pairs if p["raw"] >= self.high_threshold), key=lambda p: -p["raw"])
        report.low_correlations = [p for p in pairs if p["raw"] <= self.low_threshold]
        for p in pairs:
            del p["raw"]
        report.strong_positive_pairs = [p for p in strong if p["correlation"] > 0]
        report.strong_negative_pairs = [p for p in strong if p["correlation"] < 0]
        report.high_correlations = report.strong_positive_pairs + report.strong_negative_pairs
        if target in names_kept:
            report.target_correlations = [r.asDict() for r in target_df(clean, target, names_kept, self.method).orderBy(F.desc("abs_correlation"), "feature").collect()]
        report.recommendations = self._advice(report, target)
        return report

    def _advice(self, report: CorrelationReport, target: str | None) -> list[str]:
        n = len(report.numeric_columns)
        out = [f"{n * (n - 1) // 2} pairs of columns were compared by {report.method}."]
        if not report.high_correlations:
            out.append("No pair is strongly correlated.")
        close = [p for p in report.strong_positive_pairs if p["correlation"] >= 0.9][:5]
        out += [f"{p['column_1']} and {p['column_2']} say nearly the same ({p['correlation']:.3f}); one of them may do." for p in close]
        near = [p for p in report.strong_positive_pairs if 0.7 <= p["correlation"] < 0.9]
        if near:
            out.append(f"{len(near)} pairs are strongly, not almost wholly, correlated.")
        if report.target_correlations:
            out.append(f"Best single features for {target}: " + ", ".join(r["feature"] for r in report.target_correlations[:5]) + ".")
        out.append({"pearson": "Pearson sees linear relations only.", "spearman": "Spearman sees monotone relations.", "kendall": "Kendall sees order, and bears ties well."}[report.method])
        return out

    def get_correlation_heatmap_data(self, matrix: dict[str, dict[str, float]]) -> dict[str, Any]:
        names = list(matrix)
        z = [[matrix[a][b] for b in names] for a in names]
        notes = [{"x": b, "y": a, "text": f"{matrix[a][b]:.2f}", "font": {"color": "white" if abs(matrix[a][b]) > 0.5 else "black"}} for a in names for b in names]
        return {"x": names, "y": names, "z": z, "annotations": notes}
