import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm.quality_classifier import STATISTICS, RuleEnsemble, fit, query, scored, statistics, trained


def test_statistics():
    x = statistics(pa.array(["A b b.\nC!", None, "", "x y x y x y", "É é"]))
    col = lambda c: x[:, STATISTICS.index(c)]
    assert np.allclose(np.expm1(col("log_words")), [4, 0, 0, 6, 2])
    assert col("distinct_words")[3] == 2 / 6 and col("repeated_windows")[3] == 2 / 6
    assert col("line_ends")[0] == 0.5 and col("capitals")[0] == 0.5
    assert not x[1].any() and not x[2].any()


def test_column_equals_matrix(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, len(STATISTICS)))
    y = ((x[:, 2] > 0.3) & (x[:, 5] < 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 200
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], STATISTICS)
    got = [r[0] for r in df.select(model.column()).collect()]
    assert np.allclose(got, model.score(x))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "q"), (1, None, "q"), (2, "", "q"), (None, "a b", "q"), (3, "w " * 100_000, "q")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for labels in (none, one):
        rows = scored(docs, trained(docs, labels)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert scored(docs.limit(0), RuleEnsemble()).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in pairs]) > 0.95
    clean = [p for p, q in pairs if q]
    assert np.mean(clean) > 0.98


def test_ids_that_repeat_fit_the_same_in_any_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = docs.withColumn("text", F.lit("some other text of this id. " * 9))
    one, two = (trained(x, labels) for x in (docs.union(other).repartition(3), other.union(docs).coalesce(1)))
    assert (one.intercept, one.rules) == (two.intercept, two.rules)
