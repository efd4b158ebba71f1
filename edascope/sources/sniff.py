"""What the head of a file tells: its encoding and separator."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ENCODINGS = ["utf-8", "latin-1", "iso-8859-1", "cp1252"]
SEPARATORS = [",", "\t", ";", "|"]
HEAD = 1 << 16


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    fs, at = _place(spark, path)
    return fs.getFileStatus(at).getLen()


def head(spark: SparkSession, path: str, most: int = HEAD) -> bytes:
    """The first bytes of a file in any file system that Spark reads."""
    fs, at = _place(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def encoding(data: bytes, candidates: list[str] | None = None) -> str:
    """The first candidate that decodes the head; a character cut at its end doesn't count against one."""
    for name in candidates or ENCODINGS:
        for cut in range(4):
            try:
                data[: len(data) - cut].decode(name)
                return name
            except UnicodeDecodeError as e:
                if e.start < len(data) - 4:
                    break
    raise UnicodeDecodeError("head", data[:8], 0, 1, "no candidate encoding fits")


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line ends within quotes, so that rows go over lines; the file is read by all tasks for it."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def separator(text: str) -> str:
    """The separator that stands most often in the first five lines; a comma if none does."""
    lines = "\n".join(text.splitlines()[:5])
    counts = [lines.count(s) for s in SEPARATORS]
    return SEPARATORS[counts.index(max(counts))] if max(counts) else ","
