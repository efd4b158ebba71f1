"""Which columns are what, and the one normalisation every operator starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else T.NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def temporal(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def boolean(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def complex_(df: DataFrame) -> list[str]:
    """Columns that no analysis takes: arrays, maps, structs, binaries and the like."""
    plain = {*numeric(df, True), *text(df), *temporal(df)}
    return [c for c in df.columns if c not in plain]


def normalised(df: DataFrame) -> DataFrame:
    """df without complex columns, and with NaN as null: one projection that Spark fuses with the scan."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    skip = set(complex_(df))
    return df.select(*(F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c) for c in df.columns if c not in skip))


def unfolded(totals: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """A row for each dict of expressions over a frame of one row of totals."""
    return totals.select(F.inline(F.array(*(F.struct(*(v.alias(k) for k, v in r.items())) for r in rows))))


def bare(name: str) -> str:
    """name without characters other than letters, digits and single underscores."""
    import re

    out = re.sub(r"_+", "_", re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "_", str(name)))).strip("_")
    return out or "unnamed_column"


def human_bytes(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if abs(size) < 1024:
            return f"{size:,.1f} {unit}"
        size /= 1024
    return f"{size:,.1f} TB"
