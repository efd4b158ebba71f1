"""A weighted quality score: completeness, uniqueness, validity and consistency."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S
from edascope.types import QualityScore

WEIGHTS = {"completeness": 0.30, "uniqueness": 0.20, "validity": 0.25, "consistency": 0.25}


def _identifying(name: str) -> bool:
    return "id" in name.lower() or "key" in name.lower()


def completeness_df(df: DataFrame) -> DataFrame:
    """(completeness): cells that aren't null over all cells."""
    clean = C.normalised(df)
    given = F.lit(0)
    for c in clean.columns:
        given = given + F.count(C.quoted(c))
    return clean.agg(F.coalesce(F.try_divide(given.cast("double"), F.count("*") * len(clean.columns)), F.lit(1.0)).alias("completeness"))


def uniqueness_df(df: DataFrame) -> DataFrame:
    """(uniqueness): 1 less the share of repeated rows, less half the largest share of repeated values among columns named like ids or keys; at least 0."""
    clean = C.normalised(df)
    keys = [c for c in clean.columns if _identifying(c)]
    whole = clean.groupBy(*map(C.quoted, clean.columns)).agg(F.count("*").alias("g")).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n"), F.count("*").alias("distinct"))
    worst = F.lit(0.0)
    if keys:
        one = clean.agg(F.count("*").alias("n2"), *(F.count_distinct(C.quoted(c)).alias(f"d{i}") for i, c in enumerate(keys)), *(F.count(C.quoted(c)).alias(f"c{i}") for i, c in enumerate(keys)))
        whole = whole.crossJoin(F.broadcast(one))
        shares = [F.col("n2") - F.col(f"d{i}") - F.when(F.col(f"c{i}") < F.col("n2"), 1).otherwise(0) for i in range(len(keys))]
        top = F.greatest(*shares, F.lit(0)) if len(shares) else F.lit(0)
        worst = 0.5 * F.try_divide(top.cast("double"), F.col("n2"))
    score = F.greatest(F.lit(0.0), 1 - F.try_divide((F.col("n") - F.col("distinct")).cast("double"), F.col("n")) - worst)
    return whole.select(F.when(F.col("n") <= 1, 1.0).otherwise(score).alias("uniqueness"))


def _valid(v: Column, number: bool, boolean: bool, i: int, rules: dict[str, Any]) -> tuple[list[Column], Any]:
    """Aggregates of one column, and how its valid count follows from them: the least of the rules' counts; negatives cost half where nothing allows them."""
    aggs, parts = [], [f"n{i}"]
    checks: list[Column] = []
    # bounds are for numbers only, and a value of another type than the column's is never equal
    if "min" in rules and number:
        checks.append(v >= rules["min"])
    if "max" in rules and number:
        checks.append(v <= rules["max"])
    if "allowed" in rules:
        alike = [x for x in rules["allowed"] if not isinstance(x, str) and x is not None] if number else [str(x) for x in rules["allowed"] if isinstance(x, (str, bool))]
        checks.append((v if number else F.lower(v.cast("string")) if boolean else v.cast("string")).isin([x.lower() if boolean else x for x in alike]) if alike else F.lit(False))
    if "pattern" in rules:
        checks.append(v.cast("string").rlike(f"^(?:{rules['pattern']})"))
    for j, check in enumerate(checks):
        aggs.append(F.count_if(check).alias(f"r{i}_{j}"))
        parts.append(f"r{i}_{j}")
    least = F.least(*parts) if len(parts) > 1 else F.col(parts[0])
    if number and (rules.get("min") or 0) >= 0:
        aggs.append(F.count_if(v < 0).alias(f"m{i}"))
        share = F.try_divide(F.col(f"m{i}").cast("double"), F.col(f"n{i}"))
        least = F.when(F.col(f"m{i}") > 0, F.floor(least * (1 - 0.5 * share))).otherwise(least)
    return aggs, least


def validity_by_column_df(df: DataFrame, rules: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """(column_name, n, valid_count, validity) of columns with values."""
    clean, numbers = C.normalised(df), C.numeric(df)
    aggs, rows = [F.count("*").alias("rows")], []
    for i, c in enumerate(clean.columns):
        v = C.quoted(c)
        more, valid = _valid(v, c in numbers, c in C.boolean(df), i, (rules or {}).get(c, {}))
        aggs += [F.count(v).alias(f"n{i}"), *more]
        rows.append({"column_name": F.lit(c), "n": F.col(f"n{i}"), "valid_count": valid.cast("long"), "validity": F.try_divide(valid.cast("double"), F.col(f"n{i}"))})
    return C.unfolded(clean.agg(*aggs), rows).where("n > 0")


def validity_df(df: DataFrame, rules: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    return validity_by_column_df(df, rules).agg(F.coalesce(F.avg("validity"), F.lit(1.0)).alias("validity"))


def consistency_df(df: DataFrame, strict: bool = False) -> DataFrame:
    """(consistency): the mean of a case score for each text column and a type score, always 1 here, for each column.

    Case: the greatest share of lower, upper or title case where it is over
    0.7, else 0.5; less 0.2 where a value starts with white space (or, if
    strict, ends with it), at least 0. Columns without values count for nothing.
    """
    clean = C.normalised(df)
    texts = C.text(clean)
    aggs = []
    for i, c in enumerate(clean.columns):
        v = C.quoted(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in texts:
            aggs += [F.count_if(S.is_lower(v)).alias(f"l{i}"), F.count_if(S.is_upper(v)).alias(f"u{i}"), F.count_if(S.is_title(v)).alias(f"t{i}"), F.count_if(v.rlike(r"^\s") | (v.rlike(r"\s$") if strict else F.lit(False))).alias(f"w{i}")]
    total, size = F.lit(0.0), F.lit(0)
    for i, c in enumerate(clean.columns):
        some = F.col(f"n{i}") > 0
        total, size = total + F.when(some, 1.0).otherwise(0.0), size + some.cast("int")
        if c in texts:
            share = F.try_divide(F.greatest(f"l{i}", f"u{i}", f"t{i}").cast("double"), F.col(f"n{i}"))
            case = F.when(share > 0.7, share).otherwise(0.5) - F.when(F.col(f"w{i}") > 0, 0.2).otherwise(0.0)
            total, size = total + F.when(some, F.greatest(case, F.lit(0.0))).otherwise(0.0), size + some.cast("int")
    return clean.agg(*aggs).select(F.coalesce(F.try_divide(total, size), F.lit(1.0)).alias("consistency"))


def _weights(weights: dict[str, float] | None) -> dict[str, float]:
    given = dict(weights or WEIGHTS)
    missing = set(WEIGHTS) - set(given)
    if missing:
        raise KeyError(", ".join(sorted(missing)))
    total = sum(given[k] for k in WEIGHTS)
    return {k: given[k] / total for k in WEIGHTS}


def quality_df(df: DataFrame, weights: dict[str, float] | None = None, rules: dict[str, dict[str, Any]] | None = None, strict: bool = False) -> DataFrame:
    """(completeness, uniqueness, validity, consistency, overall): the first four from 0 to 1, overall from 0 to 100."""
    w = _weights(weights)
    row = completeness_df(df).crossJoin(uniqueness_df(df)).crossJoin(validity_df(df, rules)).crossJoin(consistency_df(df, strict))
    overall = F.lit(0.0)
    for k in WEIGHTS:
        overall = overall + F.col(k) * w[k]
    return row.withColumn("overall", 100.0 * overall)


class QualityScorer:
    def __init__(self, weights: dict[str, float] | None = None, validity_rules: dict[str, dict[str, Any]] | None = None, strict: bool = False) -> None:
        self.weights = _weights(weights)
        self.validity_rules = validity_rules or {}
        self.strict = strict

    def score(self, df: DataFrame) -> QualityScore:
        if not df.columns or df.isEmpty():
            return QualityScore(summary="There is no data to score.", improvement_areas=["The data has no rows or no columns."])
        r = quality_df(df, self.weights, self.validity_rules, self.strict).first()
        parts = {k: r[k] for k in WEIGHTS}
        areas = [f"{k.capitalize()} is {v:.1%}." for k, v in parts.items() if v < 0.9]
        clean = C.normalised(df)
        counts = clean.agg(F.count("*"), *(F.count(C.quoted(c)) for c in clean.columns)).first()
        empty = [c for i, c in enumerate(clean.columns) if counts[i + 1] < 0.5 * counts[0]]
        if empty:
            areas.append(f"More than half is missing in {', '.join(empty)}.")
        strong = [f"{k.capitalize()} is {v:.1%}." for k, v in parts.items() if v >= 0.95]
        return QualityScore(overall=round(r["overall"], 2), **{k: round(100 * v, 2) for k, v in parts.items()}, score_breakdown={k: round(v, 4) for k, v in parts.items()}, improvement_areas=areas, strengths=strong or ["No dimension stands out."])

    def compare_scores(self, current: QualityScore, previous: QualityScore) -> dict[str, Any]:
        change = round(current.overall - previous.overall, 2)
        parts = {k: {"current": getattr(current, k), "previous": getattr(previous, k), "change": round(getattr(current, k) - getattr(previous, k), 2)} for k in WEIGHTS}
        return {"current_overall": current.overall, "previous_overall": previous.overall, "change": change, "dimension_changes": parts, "trend": "improved" if change > 0 else "degraded" if change < 0 else "stable"}
