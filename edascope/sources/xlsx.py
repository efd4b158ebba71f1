"""Worksheets of .xlsx and .xlsm files, from the zipped XML itself."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edascope.sources.ship import shipped

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(data: bytes) -> list[tuple[str, str]]:
    """(name, path in the archive) of every sheet, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        return [(s.get("name"), "xl/" + links[s.get(_REL)].removeprefix("/xl/").removeprefix("xl/")) for s in sheets]


def rows_of(data: bytes, sheet: int | str = 0) -> list[list[str | None]]:
    """Cells as texts, row by row; the sheet by place or name."""
    names = sheet_names(data)
    found = names[sheet][1] if isinstance(sheet, int) and sheet < len(names) else next((p for n, p in names if n == sheet), None)
    if found is None:
        raise ValueError(f"there is no sheet {sheet!r}")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        out: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(found)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                text = None if value is None else value.text
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "b" and text is not None:
                    text = "true" if text == "1" else "false"
                elif kind == "e":
                    text = None
                cells[_column(c.get("r")) if c.get("r") else k] = text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """The sheet with its first row as header, all columns text; files are read where Spark reads them."""
    shipped(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = rows_of(bytes(data), sheet)
                yield pd.DataFrame({"n": range(len(rows)), "cells": rows})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long, cells array<string>")
    first = rows.where("n = 0").first()
    names = [c or f"column_{i}" for i, c in enumerate(first["cells"])] if first else []
    body = rows.where("n > 0")
    return body.select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)))
