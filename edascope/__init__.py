"""Exploratory data analysis on Spark: profiles, missing values, duplicates, outliers, correlations, quality and reports."""

from edascope.operators.correlation import CorrelationAnalyzer
from edascope.operators.duplicates import DuplicateAnalyzer
from edascope.operators.missing import MissingValueAnalyzer
from edascope.operators.outliers import OutlierAnalyzer
from edascope.operators.profile import DataProfiler
from edascope.operators.quality import QualityScorer
from edascope.operators.schema import SchemaDetector
from edascope.plans.engine import analyze_all
from edascope.plans.report import HTMLReportGenerator
from edascope.sources.reader import DataLoader, DataLoadError, UnsupportedFormatError
from edascope.types import (
    ColumnInfo,
    CorrelationReport,
    DataType,
    DuplicateReport,
    EDAReport,
    MissingValueReport,
    OutlierMethod,
    OutlierReport,
    QualityScore,
    SchemaProfile,
)

__version__ = "0.1.0"
__all__ = [
    "ColumnInfo", "CorrelationAnalyzer", "CorrelationReport", "DataLoadError", "DataLoader", "DataProfiler", "DataType",
    "DuplicateAnalyzer", "DuplicateReport", "EDAReport", "HTMLReportGenerator", "MissingValueAnalyzer", "MissingValueReport",
    "OutlierAnalyzer", "OutlierMethod", "OutlierReport", "QualityScore", "QualityScorer", "SchemaDetector", "SchemaProfile",
    "UnsupportedFormatError", "analyze_all",
]
