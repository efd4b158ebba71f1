"""Token counts from flat token files: a vectorised scan for end-of-document ids, stitched over blocks by a prefix scan.

A flat file is nothing but ids of fixed width, one after the other; nothing
says where documents start. Blocks of a file are scanned alone: each tells the
tokens before its first separator, those after its last, and the counts
between. What is pending at a block's start follows from a running sum over
the blocks before that starts anew at each block with a separator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import bpe
from llm import vectext as vt
from llm.shared import named, stashed

END_OF_DOCUMENT = 50256
BLOCK_BYTES = 1 << 20
#: Bytes of flat files that a task reads, and blocks that are scanned together.
TASK_BYTES, CHUNK = 1 << 27, 4096


def flat_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, end: int = END_OF_DOCUMENT, vocabulary: str | None = None) -> DataFrame:
    """Documents as flat files of 2-byte ids, one a partition, in blocks: (file, block, data, doc_ids).

    Each document is followed by `end`; blocks are full but for a file's last,
    and documents go across them. doc_ids, of the documents that start in the
    block, is the writer's own list; no reader of files has it. A null or empty
    text is a document without tokens, a null id stays null, and repeated rows
    are written as often as they come; other columns are ignored. An empty
    table gives no block.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(vocabulary, special=False)
        file, block, rest, names = TaskContext.get().partitionId(), 0, b"", []

        def row(data: bytes) -> pa.RecordBatch:
            nonlocal block, names
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([names], pa.list_(pa.int64()))], ["file", "block", "data", "doc_ids"])
            block, names = block + 1, []
            return out

        for batch in vt.pieces(batches, 2 << 20):
            ids, bounds = own.encode(batch.column(1))
            with_ends = np.insert(ids, bounds[1:], end).astype("<u2")
            starts = (bounds[:-1] + np.arange(batch.num_rows)) * 2
            keys, k, at = batch.column(0).to_pylist(), 0, -len(rest)
            rest += with_ends.tobytes()
            low = 0
            while len(rest) - low >= block_bytes:
                while k < len(keys) and starts[k] < at + low + block_bytes:
                    names.append(keys[k])
                    k += 1
                yield row(rest[low : low + block_bytes])
                low += block_bytes
            rest = rest[low:]
            names += keys[k:]
        if rest:
            yield row(rest)

    return rows.mapInArrow(run, "file long, block long, data binary, doc_ids array<long>")


def _read(path: str, start: int, size: int) -> bytes:
    """Bytes of a file in any file system that Arrow knows."""
    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    with system.open_input_file(name) as f:
        return f.read_at(size, start)


def file_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES, read: Callable[[str, int, int], bytes] = _read) -> DataFrame:
    """(file, block, data) of raw flat files of any size under a path; file is the name.

    Spark lists the files; their blocks are then dealt to tasks of about
    task_bytes, each of which reads only the bytes of its blocks, so that a
    large file is read by many. read(path, start, size) may replace Arrow's
    file systems. Empty files have no block.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    last = F.floor((F.col("length") - 1) / block_bytes)
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    ranges = ranges.repartition(max(1, -(-total // task_bytes)), "file", F.floor(F.col("block") * block_bytes / task_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = block * block_bytes
                data = read(name, start, min(block_bytes, length - start))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return ranges.mapInArrow(run, "file string, block long, data binary")


def prefixes(blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """blocks (file, block, n, seps, tail) with what stands before each: tokens (offset), separators (done), and tokens since the last separator (carry); and whether it is the file's last.

    Blocks combine as counts with a restart, which is associative: chunks of
    blocks are scanned on their own, then the chunks' sums, one row each.
    """
    blocks = blocks.withColumn("chunk", F.floor(F.col("block") / chunk))

    def scanned(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(order)
        before = upto.rowsBetween(Window.unboundedPreceding, -1)
        total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        rows = rows.withColumn("segment", F.sum((F.col("seps") > 0).cast("long")).over(upto))
        rows = rows.withColumn("pending", F.sum("tail").over(Window.partitionBy(*keys, "segment").orderBy(order)))
        return rows.select("*", total("n").alias("offset"), total("seps").alias("done"), F.coalesce(F.lag("pending").over(upto), F.lit(0)).alias("carry")).drop("segment", "pending")

    inner = scanned(blocks, ["file", "chunk"], "block")
    # a chunk's tail: what is pending behind its last block
    after = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    chunks = inner.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max_by(after, "block").alias("tail"), F.max("block").alias("highest"))
    outer = scanned(chunks, ["file"], "chunk").withColumn("top", F.max("highest").over(Window.partitionBy("file")))
    outer = outer.select("file", "chunk", F.col("offset").alias("o"), F.col("done").alias("d"), F.col("carry").alias("c"), "top")
    out = inner.join(outer, ["file", "chunk"])
    carry = F.col("carry") + F.when(F.col("done") == 0, F.col("c")).otherwise(0)
    return out.select(*(c for c in blocks.columns if c != "chunk"), (F.col("offset") + F.col("o")).alias("offset"), (F.col("done") + F.col("d")).alias("done"), carry.alias("carry"), (F.col("block") == F.col("top")).alias("last"))


def document_tokens(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the flat files that the blocks (file, block, data) make up.

    width is 2 or 4 bytes an id, little-endian; all blocks of a file but its
    last have the same size, a multiple of width. ordinal counts a file's
    documents from 0, start its tokens, separators included. A document may go
    over any number of blocks or have no token; tokens after the last
    separator are a document too. Bytes that fill no id are left out; a null
    or empty block has nothing. Repeated blocks count as one.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, head, tail, inner, seps = [], [], [], [], []
            for data in batch.column(2):
                raw = data.as_buffer() if data.is_valid else b""
                ids = np.frombuffer(raw, kind, len(raw) // width)
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                seps.append(len(at))
                head.append(int(at[0]) if len(at) else 0)
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, seps, head, tail)), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "n", "seps", "head", "tail", "inner"])

    parts = blocks.select("file", F.col("block").cast("long").alias("block"), "data")
    # counts of documents within a block are its own; the scan goes over five numbers a block, and the counts join it last
    parts = stashed(parts.mapInArrow(run, f"file {parts.schema['file'].dataType.simpleString()}, block long, n long, seps long, head long, tail long, inner array<long>").dropDuplicates(["file", "block"]))
    scan = prefixes(parts.select("file", "block", "n", "seps", "tail")).select("file", "block", "offset", "done", "carry", "last")
    parts = parts.join(scan, ["file", "block"])
    none = F.array().cast("array<long>")
    counts = F.when(F.col("seps") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(none)
    pending = F.col("tail") + F.when(F.col("seps") > 0, 0).otherwise(F.col("carry"))
    counts = F.concat(counts, F.when(F.col("last") & (pending > 0), F.array(pending)).otherwise(none))
    out = parts.select("file", "done", (F.col("offset") - F.col("carry")).alias("base"), F.posexplode(counts).alias("k", "n_tokens"))
    # a document starts behind all of its block's before it and their separators
    ahead = F.coalesce(F.sum(F.col("n_tokens") + 1).over(Window.partitionBy("file", "done", "base").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select("file", (F.col("done") + F.col("k")).alias("ordinal"), (F.col("base") + ahead).alias("start"), "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of documents, from flat files of their ids."""
    blocks = stashed(flat_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = document_tokens(blocks.select("file", "block", "data"))
    lists = blocks.select("file", "block", "doc_ids")
    size = F.size("doc_ids").cast("long")
    # documents that start before each block: the same scan, over their numbers
    starts = prefixes(lists.select("file", "block", size.alias("n"), F.lit(0).cast("long").alias("seps"), size.alias("tail"))).select("file", "block", F.col("offset").alias("base"))
    names = lists.join(starts, ["file", "block"]).select("file", "base", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")
    return found.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens")
