"""Schema detection: logical types, semantic types and cardinality of every column."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S
from edascope.operators.profile import distinct_counts_df, memory_df
from edascope.types import ColumnInfo, DataType, SchemaProfile

SAMPLE = 1000
#: More than this share of a sample must parse for a text column to be dates.
DATE_SHARE = 0.8

# Formats of dates in order of trial, and semantic types by key words of names and patterns of values.
# One letter takes one digit or two; brackets hold what may be missing.
DATE_FORMATS = ["yyyy-M-d[['T'][ ]H:m[:s[.SSSSSS]][ ][XXX]]", "yyyy/M/d[ H:m[:s[.SSSSSS]]]", "M/d/yyyy[ H:m[:s]]", "d/M/yyyy[ H:m[:s]]", "d-M-yyyy[ H:m[:s]]", "d.M.yyyy[ H:m[:s]]", "d MMM yyyy[ H:m[:s]]", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy"]
SEMANTIC_TYPES: list[tuple[str, list[str], list[str]]] = [
    ("email", ["email", "e-mail", "mail"], [r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"]),
    ("phone", ["phone", "tel", "mobile", "fax"], [r"^\+?[0-9][0-9 .()-]{5,18}[0-9]$", r"^\([0-9]{2,4}\) ?[0-9][0-9 -]{4,}$", r"^[0-9]{7,15}$"]),
    ("url", ["url", "website", "link", "homepage"], [r"^https?://", r"^www\."]),
    ("ip_address", ["ip", "ip_address", "ipv4", "ipv6"], [r"^([0-9]{1,3}\.){3}[0-9]{1,3}$", r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"]),
    ("date", ["date", "datetime", "timestamp", "created", "updated", "modified", "birth", "day"], []),
    ("name", ["name", "first_name", "last_name", "full_name", "username", "user"], []),
    ("address", ["address", "street", "city", "state", "zip", "postal", "country"], []),
    ("id", ["id", "uuid", "identifier", "key", "code", "sku", "serial"], []),
    ("money", ["price", "cost", "amount", "salary", "revenue", "budget", "fee", "income", "expense"], []),
    ("percentage", ["rate", "ratio", "percentage", "pct", "share", "proportion"], []),
]


def _may_parse(v: Column) -> Column:
    """A cheap test that every date passes and most other texts fail, as parsing is dear."""
    return F.length(v).between(8, 60) & v.rlike(r"(?<![0-9])[0-9]{4}(?![0-9])")


def parses(v: Column) -> Column:
    """Whether a text is a date in one of the known formats; null for null."""
    found = F.coalesce(*(F.try_to_timestamp(F.trim(v), F.lit(f)) for f in DATE_FORMATS)).isNotNull()
    return F.when(v.isNotNull(), F.when(_may_parse(v), found).otherwise(False))


def best_format(v: Column) -> list[Column]:
    """How many texts parse in each format, as aggregates in the order of DATE_FORMATS."""
    return [F.count_if(F.when(_may_parse(v), F.try_to_timestamp(F.trim(v), F.lit(f)).isNotNull()).otherwise(False)) for f in DATE_FORMATS]


def _fits(v: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | v.rlike(p if p.startswith("^") else f"^(?:{p})")
    return hit


def pattern_hits(df: DataFrame, column: str, patterns: list[str], sample: int | None = None) -> DataFrame:
    """(n, hits): non-null values, and those that match one of the patterns from their start."""
    v = C.quoted(column).cast("string")
    rows = df.select(v.alias("v")).where("v is not null")
    rows = rows.limit(sample) if sample else rows
    return rows.agg(F.count("*").alias("n"), F.count_if(_fits(F.col("v"), patterns)).alias("hits"))


def schema_df(df: DataFrame) -> DataFrame:
    """(column_name, spark_type, row_count, null_count, null_ratio, unique_count, unique_ratio, inferred_type, is_constant, is_empty, cardinality) of every plain column, in one lazy plan.

    Ordered rules: empty, constant, boolean, datetime, integer (whole numbers
    of any numeric type), float, and for text: dates, categories, text.
    """
    clean = C.normalised(df)
    names, kinds = clean.columns, dict(clean.dtypes)
    numbers, texts, times = C.numeric(clean), C.text(clean), C.temporal(clean)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        v = C.quoted(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in numbers:
            aggs.append(F.count_if(v.cast("double") != F.floor(v.cast("double"))).alias(f"x{i}"))
        if c in texts:
            aggs += [F.avg(F.length(v)).alias(f"x{i}"), F.avg(parses(v).cast("double")).alias(f"p{i}")]
    rows = []
    for i, c in enumerate(names):
        kind = "text" if c in texts else "number" if c in numbers else "time" if c in times else "flag"
        rows.append({
            "column_name": F.lit(c), "spark_type": F.lit(kinds[c]), "row_count": F.col("rows"), "n": F.col(f"n{i}"), "kind": F.lit(kind),
            "x": F.col(f"x{i}").cast("double") if c in texts + numbers else F.lit(None).cast("double"), "p": F.col(f"p{i}") if c in texts else F.lit(None).cast("double"),
        })
    out = C.unfolded(clean.agg(*aggs), rows).join(F.broadcast(distinct_counts_df(clean, names)), "column_name")
    n, d, kind = F.col("n"), F.col("distinct"), F.col("kind")
    ratio = F.coalesce(F.try_divide(d.cast("double"), n), F.lit(0.0))
    inferred = (
        F.when(n == 0, DataType.EMPTY.value).when(d <= 1, DataType.CONSTANT.value).when(kind == "flag", DataType.BOOLEAN.value).when(kind == "time", DataType.DATETIME.value)
        .when((kind == "number") & (F.col("x") == 0), DataType.INTEGER.value).when(kind == "number", DataType.FLOAT.value)
        .when(F.col("p") > DATE_SHARE, DataType.DATETIME.value).when((d <= 2) | (F.col("x") < 50) & (ratio < 0.5), DataType.CATEGORICAL.value).otherwise(DataType.TEXT.value)
    )
    constant = (d <= 1) & (n == F.col("row_count")) & (n > 0)
    return out.select(
        "column_name", "spark_type", "row_count", (F.col("row_count") - n).alias("null_count"), F.coalesce(F.try_divide((F.col("row_count") - n).cast("double"), F.col("row_count")), F.lit(0.0)).alias("null_ratio"),
        d.alias("unique_count"), ratio.alias("unique_ratio"), inferred.alias("inferred_type"), constant.alias("is_constant"), (n == 0).alias("is_empty"),
        F.when(n == 0, "empty").when(constant, "constant").otherwise(S.cardinality(ratio, d)).alias("cardinality"),
    )


def type_distribution_df(df: DataFrame) -> DataFrame:
    """(inferred_type, n): columns of each logical type."""
    return schema_df(df).groupBy("inferred_type").agg(F.count("*").alias("n"))


def semantic_type(name: str, inferred: str, share: Any, threshold: float = 0.8) -> str | None:
    """The first semantic type whose key word is in the name and whose patterns, if any, fit; share(patterns) tells the part that fits."""
    low = C.bare(name).lower()
    for kind, words, patterns in SEMANTIC_TYPES:
        if any(w in low for w in words) and (not patterns or share(patterns) >= threshold):
            return kind
    return {DataType.DATETIME.value: "datetime", DataType.BOOLEAN.value: "flag"}.get(inferred)


class SchemaDetector:
    def __init__(self, sample_size: int = SAMPLE, confidence_threshold: float = 0.8) -> None:
        self.sample_size = sample_size
        self.confidence_threshold = confidence_threshold

    def detect(self, df: DataFrame) -> SchemaProfile:
        skipped = C.complex_(df)
        if not df.columns or df.isEmpty():
            return SchemaProfile(skipped_columns=skipped)
        clean = C.normalised(df)
        rows = {r["column_name"]: r for r in schema_df(clean).collect()}
        memory = {r["column_name"]: r["bytes"] for r in memory_df(clean).collect()}
        head = clean.limit(self.sample_size).collect()
        hits = self._pattern_shares(clean)
        total = next(iter(rows.values()))["row_count"] if rows else df.count()
        out = SchemaProfile(row_count=total, column_count=len(df.columns), memory_usage=sum(memory.values()), memory_usage_human=C.human_bytes(sum(memory.values())), skipped_columns=skipped)
        for c in clean.columns:
            r = rows[c]

            def share(patterns: list[str], c: str = c) -> float:
                return hits.get((c, tuple(patterns)), 0.0)

            values = [x[c] for x in head if x[c] is not None][:5]
            out.columns[c] = ColumnInfo(
                name=c, inferred_type=DataType(r["inferred_type"]), spark_type=r["spark_type"], nullable=r["null_count"] > 0, unique_count=r["unique_count"], unique_ratio=r["unique_ratio"], sample_values=values,
                null_count=r["null_count"], null_ratio=r["null_ratio"], memory_usage=memory[c], semantic_type=semantic_type(c, r["inferred_type"], share, self.confidence_threshold), is_constant=r["is_constant"], is_empty=r["is_empty"], cardinality=r["cardinality"],
            )
        distinct = clean.distinct().count()
        out.duplicate_rows = total - distinct
        out.duplicate_ratio = out.duplicate_rows / total if total else 0.0
        return out

    def _pattern_shares(self, clean: DataFrame) -> dict[tuple[str, tuple[str, ...]], float]:
        """The share of values, of the first ones of each column, that fit the patterns its name calls for: one aggregate for all."""
        wanted = [(c, patterns) for c in clean.columns for _, words, patterns in SEMANTIC_TYPES if patterns and any(w in C.bare(c).lower() for w in words)]
        if not wanted:
            return {}
        # the first values of a column that aren't null, as many as the sample has, however many rows are null before them
        names = list(dict.fromkeys(c for c, _ in wanted))
        parts = [clean.where(C.quoted(c).isNotNull()).select(F.lit(i).alias("i"), C.quoted(c).cast("string").alias("v")).limit(self.sample_size) for i, c in enumerate(names)]
        values = reduce(DataFrame.union, parts).groupBy("i").agg(F.count("*").alias("n"), *(F.count_if(_fits(F.col("v"), patterns)).alias(f"h{k}") for k, (_, patterns) in enumerate(wanted)))
        rows = {r["i"]: r for r in values.collect()}
        return {(c, tuple(patterns)): rows[names.index(c)][f"h{k}"] / rows[names.index(c)]["n"] for k, (c, patterns) in enumerate(wanted) if names.index(c) in rows}

    def get_type_distribution(self, profile: SchemaProfile) -> dict[str, int]:
        out: dict[str, int] = {}
        for info in profile.columns.values():
            out[info.inferred_type.value] = out.get(info.inferred_type.value, 0) + 1
        return out

    def get_column_names_by_type(self, profile: SchemaProfile, kind: DataType) -> list[str]:
        return [c for c, info in profile.columns.items() if info.inferred_type == kind]

    def validate_schema(self, df: DataFrame, profile: SchemaProfile) -> list[str]:
        """What differs from an expected profile: missing columns, added columns, changed types, each sorted by name."""
        now = self.detect(df)
        old, new = profile.columns, now.columns
        out = [f"column {c!r} is missing" for c in sorted(set(old) - set(new))]
        out += [f"column {c!r} is not expected" for c in sorted(set(new) - set(old))]
        return out + [f"column {c!r} is {new[c].inferred_type.value}, not {old[c].inferred_type.value}" for c in sorted(set(old) & set(new)) if old[c].inferred_type != new[c].inferred_type]


def sanitize_column_name(name: str) -> str:
    return C.bare(re.sub(r"^\s+|\s+$", "", str(name)))
