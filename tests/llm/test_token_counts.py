import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import token_counts
from llm.token_counts import document_tokens, file_blocks, flat_blocks, query


def brute(ids, end):
    out, start = [], 0
    for i, t in enumerate(ids):
        if t == end:
            out.append((start, i - start))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start))
    return [(k, s, n) for k, (s, n) in enumerate(out)]


@pytest.mark.parametrize("width", [2, 4])
def test_blocks(spark, width, tmp_path, monkeypatch):
    rnd = random.Random(width)
    want = {}
    for f in range(8):
        ids = [0 if rnd.random() < [0.02, 0.3, 0, 1][f % 4] else rnd.randint(1, 60_000) for _ in range(rnd.randint(0, 900))]
        np.array(ids, f"<u{width}").tofile(tmp_path / f"{f}.bin")
        want[f] = brute(ids, 0)
    for block, chunk in ((8, 3), (64, 4096), (1 << 20, 4096)):
        monkeypatch.setattr(token_counts.prefixes, "__defaults__", (chunk,))
        rows = document_tokens(file_blocks(spark, str(tmp_path), block, task_bytes=200), end=0, width=width).collect()
        got = {f: [] for f in want}
        for r in rows:
            got[int(r.file.rsplit("/", 1)[1][0])].append((r.ordinal, r.start, r.n_tokens))
        assert {f: sorted(v) for f, v in got.items()} == want


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    np.arange(300_000, dtype="<u4").tofile(tmp_path / "one.bin")
    blocks = file_blocks(spark, str(tmp_path), 4096, task_bytes=100_000)
    assert blocks.rdd.getNumPartitions() == 12
    assert len({r.p for r in blocks.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 4
    rows = blocks.orderBy("block").collect()
    assert np.array_equal(np.frombuffer(b"".join(r.data for r in rows), "<u4"), np.arange(300_000))
    read = lambda path, start, size: b"\1\0" * (size // 2)
    assert document_tokens(file_blocks(spark, str(tmp_path), read=read), end=0).first().n_tokens == 600_000


def test_edges(spark):
    rows = [("a", 0, None), ("a", 1, b""), ("b", 0, b"\1\0\0\0\7"), ("b", 0, b"\1\0\0\0\7")]
    df = spark.createDataFrame(rows, "file string, block int, data binary")
    assert [tuple(r) for r in document_tokens(df, end=0).collect()] == [("b", 0, 0, 1)]
    assert document_tokens(df.limit(0), end=0).count() == 0


def test_documents(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: len(theirs.encode(t or "", add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in query(spark, sf).collect()} == want
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> x"), (3, "<|endoftext|> x"), (4, "w " * 50_000)], "doc_id long, text string").coalesce(1)
    blocks = flat_blocks(odd, block_bytes=1000)
    got = sorted((r.ordinal, r.n_tokens) for r in document_tokens(blocks.select("file", "block", "data")).collect())
    assert [n for _, n in got] == [len(theirs.encode(t or "", add_special_tokens=False).ids) for t in (None, "", "<|endoftext|> x", "<|endoftext|> x", "w " * 50_000)]
    assert sum((r.doc_ids for r in blocks.orderBy("block").collect()), []) == [1, 2, 3, 3, 4]
