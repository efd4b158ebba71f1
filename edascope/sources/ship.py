"""Sends this package to Python workers, once for each Spark context."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_edascope_shipped", False):
        return
    here = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="edascope-")) / "edascope_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"edascope/{f.relative_to(here)}")
    context.addPyFile(str(to))
    context._edascope_shipped = True
