"""The whole analysis of one frame."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from edascope.functions import columns as C
from edascope.operators.correlation import CorrelationAnalyzer
from edascope.operators.duplicates import DuplicateAnalyzer
from edascope.operators.missing import MissingValueAnalyzer
from edascope.operators.outliers import OutlierAnalyzer
from edascope.operators.quality import QualityScorer
from edascope.operators.schema import SchemaDetector
from edascope.types import EDAReport


def analyze_all(df: DataFrame, dataset_name: str = "dataset", keep: bool = True, **options) -> EDAReport:
    """Schema, missing values, duplicates, outliers, correlations and quality as one report.

    keep holds the plain columns in memory and on disk while the analyses read
    them; options: method of correlations, outlier_method, key_columns.
    """
    began = time.time()
    skipped = C.complex_(df)
    rows = C.normalised(df)
    if keep:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        report = EDAReport(
            dataset_name=dataset_name,
            schema=SchemaDetector().detect(rows),
            missing_values=MissingValueAnalyzer().analyze(rows),
            duplicates=DuplicateAnalyzer().analyze(rows, key_columns=options.get("key_columns")),
            outliers=OutlierAnalyzer(options.get("outlier_method", "iqr")).analyze(rows),
            correlations=CorrelationAnalyzer(options.get("method", "pearson")).analyze(rows),
            quality_score=QualityScorer().score(rows),
            warnings=[f"Column {c!r} has a complex type and was left out." for c in skipped],
        )
    finally:
        if keep:
            rows.unpersist()
    report.execution_time = time.time() - began
    return report
