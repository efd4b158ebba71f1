"""Loading of CSV and Excel files, with types found from the values."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.operators.schema import DATE_FORMATS, DATE_SHARE, best_format
from edascope.sources import sniff, xlsx

TEXT_FORMATS = {".csv", ".txt", ".tsv", ".dat"}
EXCEL_FORMATS = {".xlsx", ".xlsm"}
COLUMNAR_FORMATS = {".parquet"}

#: Names that Spark has for encodings.
SPARK_ENCODINGS = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "cp1252": "iso-8859-1", "windows-1252": "iso-8859-1"}

# Texts that a CSV file has for a missing value.
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class DataLoadError(Exception):
    """A file is missing or can't be read."""


class UnsupportedFormatError(DataLoadError):
    """No reader takes the file's format."""


def typed(raw: DataFrame, parse_dates: bool = True, narrow: bool = False) -> DataFrame:
    """Text columns as what all their values are: whole numbers, numbers, booleans, or, for most of them, dates.

    One aggregate over one scan decides for all columns. narrow casts whole
    numbers to the least type that holds them; it is off by default.
    """
    names = raw.columns
    clean = raw.select(*(F.when(~C.quoted(c).isin(NA_VALUES), C.quoted(c)).alias(c) for c in names))
    if not names:
        return clean
    aggs = []
    for i, c in enumerate(names):
        v = C.quoted(c)
        aggs += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("long")).alias(f"l{i}"), F.count(v.try_cast("double")).alias(f"d{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}"), F.min(v.try_cast("long")).alias(f"lo{i}"), F.max(v.try_cast("long")).alias(f"hi{i}")]
        if parse_dates:
            aggs.append(F.array(*best_format(v)).alias(f"f{i}"))
    found = clean.agg(*aggs).first()
    out = []
    for i, c in enumerate(names):
        n, v = found[f"n{i}"], C.quoted(c)
        if n and found[f"l{i}"] == n:
            lo, hi = found[f"lo{i}"], found[f"hi{i}"]
            kind = next((k for k, b in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << b) <= lo and hi < 1 << b), "bigint") if narrow else "bigint"
            out.append(v.cast(kind).alias(c))
        elif n and found[f"d{i}"] == n:
            out.append(v.cast("double").alias(c))
        elif n and found[f"b{i}"] == n:
            out.append((F.lower(v) == "true").alias(c))
        elif n and parse_dates and max(found[f"f{i}"]) > DATE_SHARE * n:
            best = DATE_FORMATS[found[f"f{i}"].index(max(found[f"f{i}"]))]
            out.append(F.try_to_timestamp(F.trim(v), F.lit(best)).alias(c))
        else:
            out.append(v.alias(c))
    return clean.select(*out)


class DataLoader:
    """Loads files into typed frames; keyword arguments are reader options, those of a call above those given here."""

    def __init__(self, spark: SparkSession | None = None, optimize_types: bool = False, parse_dates: bool = True, encoding_fallbacks: list[str] | None = None, **options: Any) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.optimize_types, self.parse_dates, self.options = optimize_types, parse_dates, options
        self.encoding_fallbacks = encoding_fallbacks or sniff.ENCODINGS

    def load(self, filepath: str, **options: Any) -> DataFrame:
        path = str(filepath)
        if not sniff.exists(self.spark, path):
            raise DataLoadError(f"File not found: {path}")
        suffix = PurePosixPath(path).suffix.lower()
        given = {**self.options, **options}
        if suffix in COLUMNAR_FORMATS:
            return self.spark.read.parquet(path)
        if suffix in TEXT_FORMATS:
            return self._csv(path, given)
        if suffix in EXCEL_FORMATS:
            sheet = given.get("sheet_name", 0)
            try:
                raw = xlsx.read_sheet(self.spark, path, sheet[0] if isinstance(sheet, list) and sheet else 0 if sheet is None else sheet)
                return typed(raw, self.parse_dates, self.optimize_types)
            except DataLoadError:
                raise
            except Exception as e:
                raise DataLoadError(f"Cannot read {path}: {e}") from e
        raise UnsupportedFormatError(f"Unsupported format {suffix or '(none)'}; supported are {', '.join(sorted(TEXT_FORMATS | EXCEL_FORMATS | COLUMNAR_FORMATS))}")

    def _csv(self, path: str, options: dict[str, Any]) -> DataFrame:
        data = sniff.head(self.spark, path)
        try:
            given = options.pop("encoding", None)
            code = given or sniff.encoding(data, self.encoding_fallbacks)
        except UnicodeDecodeError as e:
            raise DataLoadError(f"No encoding fits {path}") from e
        sep = options.pop("sep", None) or sniff.separator(data.decode(code, "replace"))
        if not data.strip():
            raise DataLoadError(f"{path} has no columns")
        if "multiLine" not in options:
            options["multiLine"] = sniff.has_open_quotes(self.spark, path)
        read = lambda name: self.spark.read.options(**{"header": True, "inferSchema": False, "escape": '"', **options}).csv(path, sep=sep, encoding=SPARK_ENCODINGS.get(name.lower(), name))
        raw = read(code)
        if not given and code.lower() in ("utf-8", "utf8") and self._broken(raw, read):
            # a later byte than those looked at first does not fit
            others = [x for x in self.encoding_fallbacks if x.lower() not in ("utf-8", "utf8")]
            if not others:
                raise DataLoadError(f"No encoding fits {path}")
            code = others[0]
            raw = read(code)
        if code.lower() in ("cp1252", "windows-1252"):  # Spark reads Latin-1; the bytes where they differ are put right here
            high = bytes(range(0x80, 0xA0))
            pairs = [(a, b) for a, b in zip(high.decode("latin-1"), high.decode("cp1252", "replace"), strict=True) if b != "\ufffd"]
            raw = raw.select(*(F.translate(C.quoted(c), "".join(a for a, _ in pairs), "".join(b for _, b in pairs)).alias(c) for c in raw.columns))
        return typed(raw, self.parse_dates, self.optimize_types)

    @staticmethod
    def _broken(raw: DataFrame, read: Callable[[str], DataFrame]) -> bool:
        """Whether bytes of a file read as UTF-8 were no UTF-8: more replacement characters than the file has of its own."""

        def count(df: DataFrame, mark: str) -> int:
            if not df.columns:
                return 0
            size = lambda c: F.length(C.quoted(c)) - F.length(F.replace(C.quoted(c), F.lit(mark), F.lit("")))
            in_rows = df.agg(*(F.coalesce(F.sum(size(c)), F.lit(0)).alias(f"n{i}") for i, c in enumerate(df.columns))).first()
            return sum(in_rows) // len(mark) + sum(c.count(mark) for c in df.columns)

        found = count(raw, "\ufffd")
        return found > 0 and found != count(read("iso-8859-1"), "\u00ef\u00bf\u00bd")

    def load_from_buffer(self, buffer: bytes | io.BytesIO, file_extension: str = ".csv", **options: Any) -> DataFrame:
        """A frame of bytes in the driver's memory; CSV has commas unless sep says otherwise."""
        data = buffer.read() if hasattr(buffer, "read") else bytes(buffer)
        suffix = file_extension.lower()
        if suffix in TEXT_FORMATS:
            try:
                text = data.decode(options.get("encoding") or sniff.encoding(data, self.encoding_fallbacks))
            except UnicodeDecodeError as e:
                raise DataLoadError("No encoding fits the buffer") from e
            rows = list(csv.reader(io.StringIO(text), delimiter=options.get("sep", ",")))
        elif suffix in EXCEL_FORMATS:
            try:
                rows = xlsx.rows_of(data, options.get("sheet_name") or 0)
            except Exception as e:
                raise DataLoadError(f"Cannot read the buffer: {e}") from e
        else:
            raise UnsupportedFormatError(f"Unsupported format {suffix}")
        rows = [r for r in rows if r]
        if not rows:
            raise DataLoadError("the buffer has no columns")
        width = len(rows[0])
        body = [tuple([*r, *[None] * width][:width]) for r in rows[1:]]
        raw = self.spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in rows[0]))
        return typed(raw, self.parse_dates, self.optimize_types)

    def get_file_info(self, filepath: str) -> dict[str, Any]:
        path = PurePosixPath(str(filepath))
        there = sniff.exists(self.spark, str(filepath))
        out: dict[str, Any] = {"name": path.name, "extension": path.suffix.lower(), "exists": there, "size_bytes": sniff.size(self.spark, str(filepath)) if there else 0, "is_supported": path.suffix.lower() in TEXT_FORMATS | EXCEL_FORMATS | COLUMNAR_FORMATS}
        if there:
            out["size_human"] = C.human_bytes(out["size_bytes"])
        return out

    def load_multiple(self, filepaths: list[str], concat: bool = True, **options: Any) -> DataFrame | list[DataFrame]:
        """All files that load, each with its name in __source_file__; as one frame, united by column name."""
        frames, errors = [], []
        for path in filepaths:
            try:
                frames.append(self.load(path, **options).withColumn("__source_file__", F.lit(PurePosixPath(str(path)).name)))
            except DataLoadError as e:
                errors.append(str(e))
        if not frames:
            raise DataLoadError("No file could be loaded: " + "; ".join(errors))
        return union_by_name(frames) if concat else frames


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
