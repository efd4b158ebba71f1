"""Duplicates: exact ones, by all columns or some, by key columns, in groups; and near ones by text similarity."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.sources.ship import shipped
from edascope.types import DuplicateReport

#: Rows that the compatible near-duplicate search looks at, and pairs it compares.
SAMPLE_ROWS, MOST_PAIRS = 5_000, 10_000
DETAILS, PREVIEW, GROUPS = 100, 100, 20
#: Ranges of keys that rows are numbered in; as many sizes are broadcast.
RANGES = 256
#: Buckets of the sketch that orders tokens by how often they stand, and texts of one token that a block holds.
SKETCH, BLOCK = 1 << 16, 1_000


def valid_columns(df: DataFrame, subset: list[str] | None) -> list[str]:
    """The plain columns of the subset that df has; all of them for no subset."""
    plain = [c for c in df.columns if c not in C.complex_(df)]
    return [c for c in subset if c in plain] if subset else plain


def group_counts_df(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """(key columns, group_size) of every group of equal rows; nulls are equal to nulls."""
    names = valid_columns(df, subset)
    return C.normalised(df).groupBy(*map(C.quoted, names)).agg(F.count("*").alias("group_size"))


def duplicate_counts_df(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """(rows, all_members, beyond_first): rows, rows in groups of two or more, and rows less distinct ones."""
    g = F.col("group_size")
    if not valid_columns(df, subset):
        return df.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("all_members"), F.lit(0).cast("long").alias("beyond_first"))
    return group_counts_df(df, subset).agg(F.coalesce(F.sum(g), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(g > 1, g)), F.lit(0)).alias("all_members"), F.coalesce(F.sum(g - 1), F.lit(0)).alias("beyond_first"))


def key_duplicates_df(df: DataFrame, keys: list[str]) -> DataFrame:
    """(column_name, duplicates): rows less distinct values of each key column, null being one value."""
    out = None
    for c in valid_columns(df, keys) if keys else []:
        part = duplicate_counts_df(df, [c]).select(F.lit(c).alias("column_name"), F.col("beyond_first").alias("duplicates"))
        out = part if out is None else out.union(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "column_name string, duplicates long")


def duplicate_groups_df(df: DataFrame, subset: list[str] | None = None, top: int = GROUPS) -> DataFrame:
    """(key columns, group_size): the largest groups of two or more rows; groups with a null in their key are left out."""
    names = valid_columns(df, subset)
    groups = group_counts_df(df, subset).where("group_size > 1")
    for c in names:
        groups = groups.where(C.quoted(c).isNotNull())
    return groups.orderBy(F.desc("group_size"), *map(C.quoted, names)).limit(top)


def numbered_df(rows: DataFrame, keys: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """rows with their place, from 0, in the order of keys, which none share and none lack.

    Bounds drawn by a hash of the keys part the rows into ranges of about equal
    size; rows are numbered within a range, and ranges from their sizes.
    """
    place = F.struct(*keys)
    drawn = rows.select(place.alias("k"), F.xxhash64(*keys).alias("h")).orderBy("h", "k").limit(ranges - 1)
    bounds = drawn.agg(F.array_sort(F.collect_list("k")).alias("__bounds"))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= place))).drop("__bounds")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    below = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)).cast("long") - 1
    return ranged.withColumn("__own", own).join(F.broadcast(below), "__range").withColumn(name, F.col("__own") + F.col("__below")).drop("__range", "__own", "__below")


def duplicate_rows_df(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """The rows of groups of two or more, with __duplicate_group__ from 0 in the order of keys; null where a key is null.

    Groups are numbered once a group, not once a row.
    """
    names = valid_columns(df, subset)
    if not names:
        return df
    groups = group_counts_df(df, subset).where("group_size > 1").drop("group_size").toDF(*(f"__k{i}" for i in range(len(names))))
    keys = [F.col(f"__k{i}") for i in range(len(names))]
    given = F.lit(True)
    for k in keys:
        given = given & k.isNotNull()
    numbered = numbered_df(groups.where(given), [f"__k{i}" for i in range(len(names))], "__duplicate_group__")
    named = numbered.unionByName(groups.where(~given).withColumn("__duplicate_group__", F.lit(None).cast("long")))
    same = F.lit(True)
    for c, k in zip(names, keys, strict=True):
        same = same & C.quoted(c).eqNullSafe(k)
    return df.join(named, same).drop(*(f"__k{i}" for i in range(len(names))))


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def joined_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's text columns in one, blank between; a null reads `nan`."""
    return df.withColumn("__text", F.concat_ws(" ", *(F.coalesce(C.quoted(c), F.lit("nan")) for c in columns)))


def fuzzy_pairs_df(df: DataFrame, key: str, columns: list[str] | None = None, threshold: float = 0.85, most_pairs: int = MOST_PAIRS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(index_1, index_2, similarity, preview_1, preview_2) of pairs of similar, not equal, rows, compared in order of key.

    The compatible search: of at most sample_rows rows (drawn by a hash of the
    key) the first most_pairs pairs (i, j), i before j, are compared. A pair's
    place is known from i and j alone, so the rows of the few i that have any
    are broadcast, at most sample_rows of them.
    """
    shipped(df.sparkSession)
    names = columns or C.text(df)
    rows = joined_text(df, names).select(C.quoted(key).alias("id"), F.col("__text").alias("text")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy("id")).cast("long") - 1)
    n = rows.count()
    place = F.expr(f"a.i * (2 * {n} - a.i - 1) div 2 + (b.i - a.i - 1)")
    lefts = rows.where(F.expr(f"i * (2 * {n} - i - 1) div 2 < {most_pairs}"))
    pairs = rows.alias("b").join(F.broadcast(lefts.alias("a")), (F.col("a.i") < F.col("b.i")) & (place < most_pairs))
    la, lb = F.length("a.text"), F.length("b.text")
    pairs = pairs.where((la >= 3) & (lb >= 3) & (2.0 * F.least(la, lb) / (la + lb) >= threshold))
    ratio = F.pandas_udf(_similarity, "double")
    found = pairs.select(F.col("a.id").alias("index_1"), F.col("b.id").alias("index_2"), ratio("a.text", "b.text").alias("similarity"), F.substring("a.text", 1, PREVIEW).alias("preview_1"), F.substring("b.text", 1, PREVIEW).alias("preview_2"))
    return found.where((F.col("similarity") >= threshold) & (F.col("similarity") < 1))


def _similarities(a: pd.Series, b: pd.Series, threshold: float) -> pd.DataFrame:
    """ratio(a, b) and ratio(b, a), which may differ; null where the shared characters, in any order, don't reach the threshold."""
    out = []
    for x, y in zip(a, b, strict=True):
        forward = SequenceMatcher(None, x, y)
        out.append((forward.ratio(), SequenceMatcher(None, y, x).ratio()) if forward.quick_ratio() >= threshold else (None, None))
    return pd.DataFrame(out, columns=["forward", "backward"], dtype="float64")


def _tokens(text: str, q: int) -> list[int]:
    """Grams of q characters, each with its running number in the text, as numbers; equal numbers of two only make a candidate more."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - q + 1):
        gram = text[i : i + q]
        seen[gram] += 1
        out.append(q << 32 | zlib.crc32(f"{gram}{seen[gram]}".encode("utf-8", "surrogatepass")))
    return out


def _least_shared(n: int, q: int, threshold: float) -> int:
    """How many grams of q (1 or 2) characters a text of length n shares at least with any text at the threshold.

    A ratio of t with a text of length m matches M >= t (n + m) / 2 characters,
    m being at least n t / (2 - t). The matching blocks number at most one more
    than the n + m - 2 M unmatched characters, and a block of k characters
    holds k - 1 pairs of neighbours.
    """
    both = 2 * n / (2 - threshold)
    return math.ceil((threshold / 2 * both if q == 1 else (1.5 * threshold - 1) * both - 1 if threshold > 2 / 3 else 0) - 1e-9)


def _grams(text: str, threshold: float) -> list[tuple[int, int]]:
    """(q, least shared) of the grams by which the text finds its partners: pairs, and characters if it or a partner is too short for pairs."""
    if not 0 < threshold <= 1:
        return []
    n = len(text)
    shortest = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    found = [(q, _least_shared(n, q, threshold)) for q in (1, 2)]
    return [x for x in found if (x[1] >= 1 if x[0] == 2 else _least_shared(shortest, 2, threshold) < 1)]


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2), h1 < h2, of all texts of rows (h, text) that may reach the threshold: none that does is missing.

    Prefix filter: where two texts share s of their tokens, the first
    n - s + 1 of each, in one order of all tokens, have one in common. Rare
    tokens come first, by a sketch of fixed size; any order gives all pairs.
    Tokens of many texts are dealt as pairs of blocks of texts.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(SKETCH, np.int64)
        for b in batches:
            for text in b["text"]:
                for q, _ in _grams(text, threshold):
                    np.add.at(count, np.array(_tokens(text, q), np.int64) % SKETCH, 1)
        at = np.flatnonzero(count)
        yield pd.DataFrame({"bucket": at, "n": count[at]})

    often = np.zeros(SKETCH, np.int64)
    for r in rows.select("text").mapInPandas(sketch, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        often[r["bucket"]] = r["n"]

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, text in zip(b["h"], b["text"], strict=True):
                if threshold <= 0:  # all pairs
                    out.append((h, len(text), 0))
                for q, shared in _grams(text, threshold):
                    tokens = sorted(_tokens(text, q), key=lambda t: (often[t % SKETCH], t))
                    out.extend((h, len(text), t) for t in dict.fromkeys(tokens[: len(tokens) - shared + 1]))
            yield pd.DataFrame(out, columns=["h", "n", "token"])

    tokens = rows.mapInPandas(prefixes, "h string, n long, token long")
    parts = tokens.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
    dealt = tokens.join(parts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("h"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "h", "n")
    a, b = (dealt.select("token", "low", "high", *(F.col(c).alias(f"{c}{k}") for c in ("block", "h", "n"))) for k in (1, 2))
    near = a.join(b, ["token", "low", "high"]).where("h1 < h2 and (block1 <> block2 or low = high)")
    return near.where(2.0 * F.least("n1", "n2") / (F.col("n1") + F.col("n2")) >= threshold).select("h1", "h2").distinct()


def fuzzy_blocks_df(df: DataFrame, key: str, columns: list[str] | None = None, threshold: float = 0.85) -> DataFrame:
    """(index_1, index_2, similarity) of all pairs of similar, not equal, rows whose texts have 3 characters or more.

    similarity is the ratio of the text of the lesser key to that of the
    greater. Distinct texts are compared once, those alone that pass filters
    which lose no pair: lengths, shared tokens, shared characters. Rows without
    a key can't be named and are left out. Work and result grow with the pairs
    that are alike.
    """
    shipped(df.sparkSession)
    rows = joined_text(C.normalised(df), columns or C.text(df)).select(C.quoted(key).alias("id"), F.col("__text").alias("text")).where((F.length("text") >= 3) & F.col("id").isNotNull()).withColumn("h", F.md5("text"))
    texts = rows.select("h", "text").distinct()

    def ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _similarities(a, b, threshold)

    pairs = _candidates(texts, threshold).join(texts.toDF("h1", "text1"), "h1").join(texts.toDF("h2", "text2"), "h2")
    pairs = pairs.select("h1", "h2", F.pandas_udf(ratios, "forward double, backward double")("text1", "text2").alias("s")).where(F.greatest("s.forward", "s.backward") >= threshold).select("h1", "h2", "s.forward", "s.backward")
    ids = rows.select("id", "h")
    found = pairs.join(ids.toDF("id1", "h1"), "h1").join(ids.toDF("id2", "h2"), "h2")
    found = found.select(F.least("id1", "id2").alias("index_1"), F.greatest("id1", "id2").alias("index_2"), F.when(F.col("id1") <= F.col("id2"), F.col("forward")).otherwise(F.col("backward")).alias("similarity"))
    return found.where((F.col("similarity") >= threshold) & (F.col("similarity") < 1)).distinct()


class DuplicateAnalyzer:
    def __init__(self, fuzzy_threshold: float = 0.85, max_comparisons: int = MOST_PAIRS) -> None:
        self.fuzzy_threshold = fuzzy_threshold
        self.max_comparisons = max_comparisons

    def analyze(self, df: DataFrame, subset: list[str] | None = None, key_columns: list[str] | None = None, check_fuzzy: bool = False) -> DuplicateReport:
        if not df.columns or df.isEmpty():
            return DuplicateReport()
        names = valid_columns(df, subset)
        counts = duplicate_counts_df(df, subset).first()
        total = counts["rows"]
        report = DuplicateReport(columns_analyzed=names, exact_duplicates=counts["all_members"] if names else 0)
        report.key_column_duplicates = {r["column_name"]: r["duplicates"] for r in key_duplicates_df(df, key_columns or []).collect()}
        report.duplicate_groups = [{"group_size": r["group_size"], "times_seen": r["group_size"]} for r in duplicate_groups_df(df, subset).collect()] if names else []
        if check_fuzzy and total <= self.max_comparisons:
            self._fuzzy(df, report, [c for c in names if c in C.text(df)] if subset else C.text(df), total)
        report.total_duplicates = report.exact_duplicates + report.fuzzy_duplicates
        report.duplicate_ratio = round(report.total_duplicates / total, 6)
        report.exact_duplicate_ratio = round(report.exact_duplicates / total, 6)
        report.recommendations = self._advice(report, subset)
        return report

    def _fuzzy(self, df: DataFrame, report: DuplicateReport, texts: list[str], total: int) -> None:
        if not texts:
            return
        # at most max_comparisons rows come here: places in the order that the frame has
        indexed = df.select(*map(C.quoted, texts), F.monotonically_increasing_id().alias("__id")).withColumn("__index", F.row_number().over(Window.orderBy("__id")).cast("long") - 1).drop("__id")
        rows = fuzzy_pairs_df(indexed, "__index", texts, self.fuzzy_threshold, self.max_comparisons).orderBy("index_1", "index_2").collect()
        scale = min((total / SAMPLE_ROWS) ** 2, 10) if total > SAMPLE_ROWS else 1
        report.fuzzy_duplicates = int(len(rows) * scale)
        report.fuzzy_duplicate_details = [{**r.asDict(), "similarity": round(r["similarity"], 4)} for r in rows[:DETAILS]]

    def _advice(self, report: DuplicateReport, subset: list[str] | None) -> list[str]:
        out = []
        if report.exact_duplicate_ratio > 0.1:
            out.append(f"CRITICAL: {report.exact_duplicate_ratio:.1%} of the rows have an exact double.")
        elif report.exact_duplicates:
            out.append(f"{report.exact_duplicates} rows have an exact double.")
        if report.fuzzy_duplicates:
            out.append(f"About {report.fuzzy_duplicates} pairs of rows are nearly equal; look through them before removing any.")
        if subset and report.exact_duplicates:
            out.append(f"Rows were compared by {', '.join(report.columns_analyzed)} only.")
        out += [f"Key column {c!r} has {n} repeated values." for c, n in report.key_column_duplicates.items() if n]
        if report.exact_duplicates:
            out.append("df.dropDuplicates() removes the exact ones.")
        return out or ["No duplicate rows were found."]

    def find_duplicate_groups(self, df: DataFrame, subset: list[str] | None = None) -> DataFrame:
        return duplicate_rows_df(df, subset)
