"""Logical types, outlier methods and the driver-side result records."""

from __future__ import annotations

# The names, values and fields of these types and records are a contract with their users.
from dataclasses import dataclass, field
from datetime import datetime
from enum import StrEnum
from typing import Any


class DataType(StrEnum):
    """Logical column types; NUMERIC is kept for callers, detection never gives it."""

    INTEGER = "integer"
    FLOAT = "float"
    NUMERIC = "numeric"
    CATEGORICAL = "categorical"
    TEXT = "text"
    DATETIME = "datetime"
    BOOLEAN = "boolean"
    CONSTANT = "constant"
    EMPTY = "empty"


class OutlierMethod(StrEnum):
    IQR = "iqr"
    ZSCORE = "zscore"
    MODIFIED_ZSCORE = "modified_zscore"
    ISOLATION_FOREST = "isolation_forest"
    LOF = "lof"


@dataclass
class ColumnInfo:
    name: str
    inferred_type: DataType
    spark_type: str
    nullable: bool
    unique_count: int
    unique_ratio: float
    sample_values: list[Any]
    null_count: int
    null_ratio: float
    memory_usage: int
    semantic_type: str | None = None
    is_constant: bool = False
    is_empty: bool = False
    cardinality: str = "unknown"


@dataclass
class SchemaProfile:
    columns: dict[str, ColumnInfo] = field(default_factory=dict)
    row_count: int = 0
    column_count: int = 0
    memory_usage: int = 0
    memory_usage_human: str = "0.0 B"
    duplicate_rows: int = 0
    duplicate_ratio: float = 0.0
    skipped_columns: list[str] = field(default_factory=list)


@dataclass
class MissingValueReport:
    total_missing: int = 0
    total_cells: int = 0
    overall_missing_ratio: float = 0.0
    column_missing: dict[str, dict[str, Any]] = field(default_factory=dict)
    missing_patterns: list[dict[str, Any]] = field(default_factory=list)
    columns_with_missing: list[str] = field(default_factory=list)
    completely_empty_columns: list[str] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)


@dataclass
class DuplicateReport:
    total_duplicates: int = 0
    duplicate_ratio: float = 0.0
    exact_duplicates: int = 0
    exact_duplicate_ratio: float = 0.0
    fuzzy_duplicates: int = 0
    fuzzy_duplicate_details: list[dict[str, Any]] = field(default_factory=list)
    duplicate_groups: list[dict[str, Any]] = field(default_factory=list)
    columns_analyzed: list[str] = field(default_factory=list)
    key_column_duplicates: dict[str, int] = field(default_factory=dict)
    recommendations: list[str] = field(default_factory=list)


@dataclass
class OutlierReport:
    columns_analyzed: list[str] = field(default_factory=list)
    outliers_by_column: dict[str, dict[str, Any]] = field(default_factory=dict)
    total_outliers: int = 0
    outlier_ratio: float = 0.0
    method_used: str = OutlierMethod.IQR.value
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    extreme_outliers: dict[str, int] = field(default_factory=dict)
    outlier_indices: dict[str, list[Any]] = field(default_factory=dict)
    multivariate_outliers: int | None = None
    recommendations: list[str] = field(default_factory=list)


@dataclass
class CorrelationReport:
    correlation_matrix: dict[str, dict[str, float]] = field(default_factory=dict)
    method: str = "pearson"
    numeric_columns: list[str] = field(default_factory=list)
    high_correlations: list[dict[str, Any]] = field(default_factory=list)
    low_correlations: list[dict[str, Any]] = field(default_factory=list)
    strong_positive_pairs: list[dict[str, Any]] = field(default_factory=list)
    strong_negative_pairs: list[dict[str, Any]] = field(default_factory=list)
    target_correlations: list[dict[str, Any]] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)


def grade(score: float) -> str:
    """A from 90, B from 80, C from 70, D from 60, else F."""
    return next((g for least, g in ((90, "A"), (80, "B"), (70, "C"), (60, "D")) if score >= least), "F")


@dataclass
class QualityScore:
    """Scores from 0 to 100; score_breakdown has them from 0 to 1."""

    overall: float = 0.0
    completeness: float = 0.0
    uniqueness: float = 0.0
    validity: float = 0.0
    consistency: float = 0.0
    score_breakdown: dict[str, float] = field(default_factory=dict)
    grade: str = ""
    summary: str = ""
    improvement_areas: list[str] = field(default_factory=list)
    strengths: list[str] = field(default_factory=list)

    @property
    def overall_score(self) -> float:
        return self.overall

    @property
    def completeness_score(self) -> float:
        return self.completeness

    @property
    def uniqueness_score(self) -> float:
        return self.uniqueness

    @property
    def validity_score(self) -> float:
        return self.validity

    @property
    def consistency_score(self) -> float:
        return self.consistency

    def __post_init__(self) -> None:
        self.grade = self.grade or grade(self.overall)
        self.summary = self.summary or f"Data quality is {self.overall:.1f} of 100, grade {self.grade}."


@dataclass
class EDAReport:
    dataset_name: str = "dataset"
    schema: SchemaProfile | None = None
    missing_values: MissingValueReport | None = None
    duplicates: DuplicateReport | None = None
    outliers: OutlierReport | None = None
    correlations: CorrelationReport | None = None
    quality_score: QualityScore | None = None
    execution_time: float = 0.0
    generated_at: datetime = field(default_factory=datetime.now)
    version: str = "0.1.0"
    warnings: list[str] = field(default_factory=list)
    info: dict[str, Any] = field(default_factory=dict)
