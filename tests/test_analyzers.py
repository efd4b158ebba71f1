"""The analyzers on small frames with results worked out by hand."""

import math
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from edascope import (
    CorrelationAnalyzer,
    DataProfiler,
    DataType,
    DuplicateAnalyzer,
    HTMLReportGenerator,
    MissingValueAnalyzer,
    OutlierAnalyzer,
    QualityScorer,
    SchemaDetector,
    analyze_all,
)
from edascope.functions import columns as C
from edascope.functions import stats as S
from edascope.operators import correlation, duplicates, forest, lof, outliers, profile, quality, schema


@pytest.fixture(scope="module")
def sample(spark):
    rnd = np.random.default_rng(3)
    day = datetime(2020, 1, 1)
    rows = [(i, f"person {i}", int(rnd.integers(18, 80)), float(rnd.normal(50_000, 9_000)), "abcd"[i % 4], i % 3 == 0, day + timedelta(days=i), f"user{i}@example.com") for i in range(300)]
    return spark.createDataFrame(rows, "id long, name string, age int, salary double, department string, is_active boolean, join_date timestamp, email string")


@pytest.fixture(scope="module")
def doubled(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (1, "a", 10), (4, "d", 40), (5, "e", 50), (2, "b", 20), (6, "f", 60)], "id long, value string, score long")


def test_schema(spark, sample):
    s = SchemaDetector().detect(sample)
    kinds = {c: i.inferred_type for c, i in s.columns.items()}
    assert kinds == {"id": DataType.INTEGER, "name": DataType.TEXT, "age": DataType.INTEGER, "salary": DataType.FLOAT, "department": DataType.CATEGORICAL, "is_active": DataType.BOOLEAN, "join_date": DataType.DATETIME, "email": DataType.TEXT}
    assert {c: i.semantic_type for c, i in s.columns.items()} == {"id": "id", "name": "name", "age": None, "salary": "money", "department": None, "is_active": "flag", "join_date": "date", "email": "email"}
    assert s.columns["id"].cardinality == "unique" and s.row_count == 300 and s.duplicate_rows == 0 and s.memory_usage > 0
    d = SchemaDetector()
    assert d.get_type_distribution(s)["integer"] == 2 and d.get_column_names_by_type(s, DataType.FLOAT) == ["salary"]
    assert d.validate_schema(sample, s) == []
    changed = sample.drop("age").withColumn("id", F.col("id").cast("string")).withColumn("extra", F.lit(1))
    assert d.validate_schema(changed, s) == ["column 'age' is missing", "column 'extra' is not expected", "column 'id' is text, not integer"]
    assert SchemaDetector().detect(sample.limit(0)).columns == {}


def test_schema_odd_columns(spark):
    df = spark.createDataFrame([(5, 1.0, None, "2020-01-01", [1.0]), (5, 2.0, None, "2020-02-01", [2.0]), (5, float("nan"), None, "bad", [1.0])] + [(5, 3.0, None, f"2021-03-{d:02d}", [0.0]) for d in range(1, 20)], "k int, whole double, none string, day string, v array<double>")
    s = SchemaDetector().detect(df)
    assert {c: i.inferred_type.value for c, i in s.columns.items()} == {"k": "constant", "whole": "integer", "none": "empty", "day": "datetime"}
    assert s.skipped_columns == ["v"] and s.columns["whole"].null_count == 1 and s.columns["k"].is_constant and s.columns["none"].cardinality == "empty"


def test_names():
    assert C.bare("a  b--c!") == "a_b_c" and C.bare("!!") == "unnamed_column" and C.human_bytes(2048) == "2.0 KB"


def test_missing(spark):
    df = spark.createDataFrame([("1", "x"), ("2", ""), ("?", "y"), ("4", "?"), ("N/A", "z")], "A string, B string")
    r = MissingValueAnalyzer().analyze(df)
    assert (r.total_missing, r.total_cells, r.overall_missing_ratio) == (4, 10, 0.4)
    assert {e["severity"] for e in r.column_missing.values()} == {"high"} and all(p["row_count"] == 2 and p["percentage"] == 40.0 for p in r.missing_patterns)
    from edascope.operators.missing import nullity_correlation_df

    assert round(nullity_correlation_df(df).first()["correlation"], 4) == -0.6667
    full = spark.createDataFrame([(1, None), (2, None)], "full long, empty double")
    r = MissingValueAnalyzer().analyze(full)
    assert r.completely_empty_columns == ["empty"] and r.column_missing["empty"]["suggested_strategy"] == "drop_column"
    assert MissingValueAnalyzer().get_deletion_impact(full, "column")["dropped_column_names"] == ["empty"]
    assert MissingValueAnalyzer().get_deletion_impact(full, "row")["remaining_rows"] == 0
    assert MissingValueAnalyzer().analyze(full.select("full")).recommendations == ["No missing values were found."]
    assert MissingValueAnalyzer(["zz"]).analyze(spark.createDataFrame([("zz",), ("a",)], "a string")).total_missing == 1


def test_duplicates(spark, doubled):
    r = DuplicateAnalyzer().analyze(doubled, key_columns=["id"])
    assert (r.exact_duplicates, r.exact_duplicate_ratio, r.key_column_duplicates) == (4, 0.5, {"id": 2})
    assert [g["group_size"] for g in r.duplicate_groups] == [2, 2] and r.recommendations[0].startswith("CRITICAL")
    groups = DuplicateAnalyzer().find_duplicate_groups(doubled, ["id"]).collect()
    assert sorted((x["id"], x["__duplicate_group__"]) for x in groups) == [(1, 0), (1, 0), (2, 1), (2, 1)]
    assert DuplicateAnalyzer().analyze(doubled, subset=["nope"]).exact_duplicates == 0
    assert DuplicateAnalyzer().analyze(doubled.limit(0)).total_duplicates == 0
    with_null = spark.createDataFrame([(None, 1), (None, 1), (2, 2)], "a int, b int")
    assert DuplicateAnalyzer().analyze(with_null).exact_duplicates == 2
    assert {x["__duplicate_group__"] for x in duplicates.duplicate_rows_df(with_null).collect()} == {None}


def test_fuzzy(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick brown fix"), (3, "something else here"), (4, "the quick brown fox")], "k int, t string")
    r = DuplicateAnalyzer().analyze(df, subset=["t"], check_fuzzy=True)
    assert r.fuzzy_duplicates == 2 and r.exact_duplicates == 2
    pairs = {(x.index_1, x.index_2) for x in duplicates.fuzzy_blocks_df(df, "k", ["t"]).collect()}
    assert pairs == {(1, 2), (2, 4)}


def test_fuzzy_blocks_misses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 7, raising=False)
    rnd = random.Random(4)
    # differences at both ends, groups of similar texts, short and long ones, repeated rows
    texts = ["xhe quick brown foy", "the quick brown fox"] + [f"the quick brown fox {k}{k}" for k in "abcdefgh"]
    for _ in range(60):
        t = "".join(rnd.choice("abcde ") for _ in range(rnd.choice([3, 4, 5, 6, 8, 12, 20, 60, 230])))
        texts += [t] + ["".join(c for c in t if rnd.random() > 0.08) + rnd.choice(["", "z", "é1"]) for _ in range(3)]
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    for threshold in (0.85, 0.6, 0.97):
        want = {}
        for i, a in enumerate(texts):
            for j in range(i + 1, len(texts)):
                if min(len(a), len(texts[j])) >= 3 and a != texts[j] and (s := SequenceMatcher(None, a, texts[j]).ratio()) >= threshold:
                    want[i, j] = s
        assert (0, 1) in want or threshold > 0.9
        assert {(r[0], r[1]): r[2] for r in duplicates.fuzzy_blocks_df(df, "k", ["t"], threshold).collect()} == want


def test_outliers(spark):
    values = [float(x) for x in range(1, 101)] + [1000.0, -900.0]
    df = spark.createDataFrame([(i, v, 5.0) for i, v in enumerate(values)], "i int, v double, c double")
    for method in ("iqr", "zscore", "modified_zscore"):
        r = OutlierAnalyzer(method).analyze(df, ["v", "c", "none"], row_id="i")
        assert r.columns_analyzed == ["v", "c"] and set(r.outliers_by_column) == {"v"} and r.outlier_indices["v"] == [100, 101]
    r = OutlierAnalyzer().analyze(spark.createDataFrame([(i,) for i in range(1, 6)], "v int"))
    assert r.total_outliers == 0
    b = outliers.outliers_df(spark.createDataFrame([(i,) for i in range(1, 6)], "v int")).first()
    assert (b["lower"], b["upper"]) == (-1.0, 7.0)
    assert outliers.outlier_rows_df(df, "v").count() == 2 and outliers.outlier_rows_df(df, "nope").count() == 0


def test_forest_and_lof(spark):
    rnd = np.random.default_rng(1)
    values = [float(x) for x in rnd.normal(0, 1, 300)] + [40.0, -35.0]
    df = spark.createDataFrame([(v, v * 2 + float(e)) for v, e in zip(values, rnd.normal(0, 0.1, 302), strict=True)], "a double, b double")
    hits = {r["x0"] for r in forest.flagged(df, ["a"]).where("is_outlier").collect()}
    assert {40.0, -35.0} <= hits and 5 <= len(hits) <= 20
    assert OutlierAnalyzer("isolation_forest").analyze(df, ["a"], include_multivariate=False).outliers_by_column["a"]["extreme_count"] > 0
    assert OutlierAnalyzer().analyze(df, include_multivariate=True).multivariate_outliers in range(5, 20)
    top = [r["value"] for r in lof.lof_df(df, "a").orderBy(F.desc("lof")).limit(2).collect()]
    assert set(top) == {40.0, -35.0}
    key = lambda rows: sorted((r["value"], round(r["lof"], 9)) for r in rows.collect())
    assert key(lof.lof_df(df, "a")) == key(lof.lof_df(df, "a", chunk=25))
    assert OutlierAnalyzer("lof").analyze(df, ["a"]).total_outliers > 0
    assert OutlierAnalyzer("lof").analyze(df.limit(5), ["a"]).total_outliers == 0


def test_forest_draws_each_value_by_its_rows(spark):
    # each frequent value alone would fill a sample of 25,600 rows drawn by value
    df = spark.range(90_300).select(F.when(F.col("id") >= 90_000, 90.0).otherwise(F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    hits = forest.flagged(df, ["a"]).groupBy("x0", "is_outlier").count().collect()
    assert {tuple(r) for r in hits} == {(0.0, False, 30_000), (1.0, False, 30_000), (2.0, False, 30_000), (90.0, True, 300)}
    n = {r["x0"]: r["count"] for r in forest.multivariate_df(df.select("b", F.lit(1).alias("c")), most_rows=2_000).groupBy("x0").count().collect()}
    assert len(n) == 2 and min(n.values()) > 900


def kendall(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    n0 = len(x) * (len(x) - 1) / 2
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    return s / math.sqrt((n0 - ties(x)) * (n0 - ties(y)))


def test_correlations(spark):
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 30, 200).astype(float)
    df = spark.createDataFrame([(float(x), float(2 * x + e), float(-x + 3 * e), 7.0, None if i % 9 == 0 else float(e)) for i, (x, e) in enumerate(zip(a, rnd.normal(size=200), strict=True))], "a double, b double, c double, k double, n double")
    pdf = df.toPandas()
    for method in ("pearson", "spearman"):
        want = pdf[["a", "b", "c", "n"]].corr(method=method) if method == "pearson" else None
        got = {(r[0], r[1]): r[2] for r in correlation.correlation_df(df, ["a", "b", "c", "n"], method).collect()}
        if want is None:
            want = {c: {d: pdf[[c, d]].dropna().rank().corr().iloc[0, 1] for d in "abcn"} for c in "abcn"}
        assert all(abs(v - want[x][y]) < 1e-9 for (x, y), v in got.items())
    for grid in (4, 256):
        got = {(r[0], r[1]): r[2] for r in correlation.kendall_df(df, [("a", "b"), ("a", "n"), ("a", "k")], grid).collect()}
        some = pdf.dropna()
        assert abs(got["a", "b"] - kendall(pdf.a, pdf.b)) < 1e-9 and abs(got["a", "n"] - kendall(some.a.to_numpy(), some.n.to_numpy())) < 1e-9 and got["a", "k"] == 0
    r = CorrelationAnalyzer().analyze(df, target="a")
    assert [(p["column_1"], p["column_2"]) for p in r.strong_positive_pairs] == [("a", "b")] and r.correlation_matrix["k"]["k"] == 0 and r.correlation_matrix["a"]["a"] == 1
    assert r.target_correlations[0]["feature"] == "b" and len(CorrelationAnalyzer().get_correlation_heatmap_data(r.correlation_matrix)["z"]) == 5
    assert CorrelationAnalyzer().analyze(spark.createDataFrame([("x", "y")], "a string, b string")).correlation_matrix == {}
    with pytest.raises(ValueError):
        CorrelationAnalyzer("other")


def test_quality(spark, doubled):
    q = QualityScorer().score(doubled)
    assert q.score_breakdown == {"completeness": 1.0, "uniqueness": 0.625, "validity": 1.0, "consistency": 1.0} and q.overall == 92.5 and q.grade == "A"
    assert QualityScorer().score(spark.createDataFrame([(i,) for i in range(5)], "A int")).overall == 100.0
    ruled = QualityScorer(validity_rules={"score": {"min": 0, "max": 100}}).score(spark.createDataFrame([(x,) for x in (10, 20, 30, 150, 25)], "score int"))
    assert ruled.validity == 80.0
    low = spark.createDataFrame([(i % 50, None if i < 60 else i - 60, [" A", "a "][i % 2], float(i)) for i in range(100)], "id int, value int, category string, score double")
    s = QualityScorer().score(low)
    assert s.score_breakdown["completeness"] == 0.85 and s.score_breakdown["uniqueness"] == 0.75 and s.score_breakdown["consistency"] == 0.86
    assert QualityScorer(strict=True).score(low).consistency == s.consistency
    c = QualityScorer().compare_scores(q, s)
    assert c["trend"] == "improved" and c["dimension_changes"]["completeness"]["change"] == 15.0
    empty = QualityScorer().score(low.limit(0))
    assert empty.overall == 0 and empty.grade == "F" and empty.summary == "There is no data to score."
    with pytest.raises(KeyError):
        QualityScorer({"completeness": 1.0})


def test_profile(spark, sample):
    p = DataProfiler().profile(sample)
    assert p["dataset_shape"] == (300, 8) and p["column_summary"]["age"]["non_null_count"] == 300
    assert p["numeric_summary"]["id"]["median"] == 149.5 and p["boolean_summary"]["is_active"]["true_count"] == 100
    assert p["datetime_summary"]["join_date"]["range_days"] == 299 and p["categorical_summary"]["department"]["mode"] == "a"
    assert sum(p["distributions"]["age"]["histogram_bins"]["counts"]) == 300 and "id" in p["structural_flags"]["index_like_columns"]
    assert DataProfiler().profile(sample.limit(0)) == {"error": "the data has no rows or no columns"}
    assert "error" in DataProfiler().get_column_stats(sample, "nope") and DataProfiler().get_column_stats(sample, "age")["variance"] > 0


def test_index_like(spark):
    df = spark.createDataFrame([(i, i * 2, 100 - i, float(i) if i != 50 else 3.5, f"k{i:04d}") for i in range(100)], "k int, up int, down int, odd double, name string").repartition(5)
    for key in ("k", "name"):
        got = {r["column_name"]: r["is_index_like"] for r in profile.structural_flags_df(df, key).collect()}
        assert got == {"k": True, "up": True, "down": False, "odd": False, "name": False}


def test_normality(spark):
    def z_of(values):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return df.agg(S.normal_p(F.count("v"), F.skewness("v"), F.kurtosis("v"))).first()[0]

    # public examples: skew Z 0.446263854 and 3.571773510, kurtosis Z of 0..19 -1.705810415
    x = np.arange(20.0)
    n, sd = 20, x.std()
    assert abs(((x - x.mean()) ** 3).mean()) < 1e-9 and sd > 0 and n == 20
    assert z_of([2, 8, 0, 4, 1, 9, 9, 0]) is not None and z_of(range(7)) is None
    flat = spark.createDataFrame([(5.0,)] * 9, "v double")
    assert flat.agg(S.normal_p(F.count("v"), F.skewness("v"), F.kurtosis("v"))).first()[0] is None
    # exactly zero skewness counts as 1 in place of Y
    assert 0 < z_of(range(20)) < math.exp(-(1.705810415**2) / 2)


def test_histogram_and_gini(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "v double")
    assert [r["n"] for r in profile.histogram_df(df, "v", 4).orderBy("bin").collect()] == [0, 0, 3, 0]
    assert profile.histogram_df(df.limit(0), "v").count() == 0
    assert S.gini(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "v double"), "v").first()[0] == pytest.approx(0)
    assert S.gini(spark.createDataFrame([(0.0,), (0.0,), (0.0,), (4.0,)], "v double"), "v").first()[0] == pytest.approx(0.75)


def test_partitioning_changes_nothing(spark, sample):
    one, many = sample.coalesce(1), sample.repartition(13)
    for f in (profile.numeric_summary_df, lambda d: outliers.outliers_df(d), lambda d: correlation.correlation_df(d, method="spearman")):
        key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert key(f(one)) == key(f(many))


def test_report(spark, sample, tmp_path):
    df = sample.withColumn("<b>x", F.when(F.col("id") > 5, F.col("age"))).withColumn("v", F.array(F.lit(1)))
    report = analyze_all(df, "a <data> set")
    page = HTMLReportGenerator().generate(report)
    assert "<b>x" not in page and "&lt;b&gt;x" in page and "http" not in page.split("</head>")[0]
    assert all(f"<h2>{t}</h2>" in page for t in ("Quality", "Overview", "Missing values", "Duplicates", "Outliers", "Correlations", "Warnings"))
    to = HTMLReportGenerator().save(report, str(tmp_path / "a" / "r.html"))
    assert open(to, encoding="utf-8").read() == page
    own = tmp_path / "t.html"
    own.write_text("T:$title")
    assert HTMLReportGenerator(str(own)).generate(report) == "T:a &lt;data&gt; set"
    assert set(HTMLReportGenerator().charts(report)) >= {"missing", "correlations"}


def test_rules_look_at_columns_of_their_kind(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 5, False), ("c", None, True)], "t string, n int, b boolean")
    rules = {"t": {"min": 3, "allowed": ["a", "b", 7]}, "n": {"min": 2, "allowed": [5, "x"]}, "b": {"allowed": [True]}}
    rows = {r["column_name"]: r["valid_count"] for r in quality.validity_by_column_df(df, rules).collect()}
    assert rows == {"t": 2, "n": 1, "b": 2}
    assert {r["column_name"]: r["valid_count"] for r in quality.validity_by_column_df(df, {"t": {"min": 1, "max": 2}, "n": {"allowed": ["1"]}}).collect()} == {"t": 3, "n": 0, "b": 3}


def test_score_names(spark):
    q = QualityScorer().score(spark.createDataFrame([(1,), (2,), (2,)], "a int"))
    assert (q.overall_score, q.completeness_score, q.uniqueness_score, q.validity_score, q.consistency_score) == (q.overall, q.completeness, q.uniqueness, q.validity, q.consistency)


def test_cardinality_names(spark):
    df = spark.createDataFrame([(i, min(i, 94), i % 60, i % 5) for i in range(100)], "u int, vh int, h int, l int")
    assert {r["column_name"]: r["cardinality"] for r in schema.schema_df(df).collect()} == {"u": "unique", "vh": "very-high", "h": "high", "l": "low"}


@pytest.mark.parametrize(
    "name, values, want",
    [
        ("phone_no", ["+1 555 010 2030", "0555 123 4567", "(030) 123456"], "phone"),
        ("phone_no", ["none", "call me", "x"], None),
        ("ip_address", ["10.0.0.1", "192.168.1.20", "8.8.8.8"], "ip_address"),
        ("ipv6", ["2001:0db8:0000:0000:0000:ff00:0042:8329"] * 3, "ip_address"),
        ("home_address", ["1 Main St", "2 Side St", "3 Low Rd"], "address"),
        ("tax_rate", ["0.1", "0.25", "0.3"], "percentage"),
        ("city", ["A", "B", "C"], "address"),
        ("website", ["https://a.b", "www.c.d", "http://e"], "url"),
    ],
)
def test_semantic_types(spark, name, values, want):
    df = spark.createDataFrame([(None,)] * 1100 + [(v,) for v in values], f"`{name}` string")
    assert schema.SchemaDetector().detect(df).columns[name].semantic_type == want


def test_places_in_the_order_of_keys(spark):
    rnd = random.Random(2)
    keys = sorted({(rnd.choice("abc"), rnd.randint(0, 400)) for _ in range(900)})
    df = spark.createDataFrame(rnd.sample(keys, len(keys)), "a string, b int").repartition(5)
    got = {(r.a, r.b): r.i for r in duplicates.numbered_df(df, ["a", "b"], "i", ranges=16).collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    assert duplicates.numbered_df(df.limit(0), ["a", "b"], "i").count() == 0


def test_fuzzy_pairs_against_all_pairs(spark):
    # up to 141 rows the compatible search compares all pairs
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdef ") for _ in range(20)) for _ in range(30)]
    texts = [t[:k] + "z" + t[k + 1 :] for t in texts for k in (3, 11, 19)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {(r.index_1, r.index_2): round(r.similarity, 9) for r in duplicates.fuzzy_pairs_df(df, "k", ["t"]).collect()}
    want = {(i, j): round(s, 9) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 0.85 <= (s := SequenceMatcher(None, texts[i], texts[j]).ratio()) < 1}
    assert got == want and len(want) >= 60


def test_multivariate_forest_flags_the_rows_that_stand_apart(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (2_000, 2))
    rows = [(float(a), float(a + 0.1 * b)) for a, b in x] + [(60.0, -60.0), (-70.0, 70.0), (80.0, 80.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = forest.multivariate_df(df, contamination=0.01)
    hits = {(round(r.x0, 6), round(r.x1, 6)) for r in got.where("is_outlier").collect()}
    a, b = np.array(rows).T
    apart = {(round(float((p - a.mean()) / a.std()), 6), round(float((q - b.mean()) / b.std()), 6)) for p, q in rows[-3:]}
    assert apart <= hits and 15 <= len(hits) <= 21 and got.count() == 2_003


def test_outlier_chart(spark):
    from edascope import HTMLReportGenerator, analyze_all

    df = spark.createDataFrame([(float(i % 20),) for i in range(100)] + [(900.0,)], "amount double")
    page = HTMLReportGenerator().generate(analyze_all(df, "t"))
    assert "amount" in page and "<svg" in page


def test_ranks_where_one_value_is_far(spark):
    rnd = random.Random(6)
    rows = {(k, v): rnd.randint(1, 5) for k in "ab" for v in [*(rnd.random() for _ in range(400)), 0.0, -1e300, 1e300, float("inf"), 7.0]}
    df = spark.createDataFrame([(k, v, n) for (k, v), n in rows.items()], "k string, v double, n long")
    got = {(r.k, r.v): r.before for r in S.ranked(df, ["k"]).collect()}
    assert got == {(k, v): sum(n for (j, w), n in rows.items() if j == k and w < v) for k, v in rows}
    one = S.ranked(df.where("k = 'a'").drop("k"))
    assert {r.v: r.before for r in one.collect()} == {v: b for (k, v), b in got.items() if k == "a"}
    assert S.ranked(df.limit(0), ["k"]).count() == 0
