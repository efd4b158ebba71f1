"""Isolation forests (Liu, Ting and Zhou, 2008): trees grow on the driver from small samples, scores come from Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.sources.ship import shipped

TREES, SAMPLE = 100, 256
LEAST_ROWS = 10
#: Equal rows that one step of a draw numbers.
STEP = 10_000


def average_path(n: float) -> float:
    """The mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays: column, bound, left and right child, and the path length added at leaves."""

    def __init__(self, sample: np.ndarray, seed: int, trees: int = TREES) -> None:
        rnd = np.random.default_rng(seed)
        self.size = min(SAMPLE, len(sample))
        self.trees = []
        for _ in range(trees):
            part = sample[rnd.choice(len(sample), self.size, replace=False)]
            nodes: list[list[float]] = []
            self._grow(part, 0, math.ceil(math.log2(max(2, self.size))), rnd, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, depth: int, limit: int, rnd: np.random.Generator, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + average_path(len(x))])
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
        if depth < limit and len(spread):
            k = int(rnd.choice(spread))
            bound = rnd.uniform(x[:, k].min(), x[:, k].max())
            low = x[:, k] < bound
            left = self._grow(x[low], depth + 1, limit, rnd, nodes)
            right = self._grow(x[~low], depth + 1, limit, rnd, nodes)
            nodes[at][:4] = [k, bound, left, right]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the sooner a row is alone."""
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                k = tree[at, 0].astype(np.int64)
                inner = np.flatnonzero(k >= 0)
                if not len(inner):
                    break
                low = x[inner, k[inner]] < tree[at[inner], 1]
                at[inner] = np.where(low, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
            total += tree[at, 4]
        return 2.0 ** (-total / len(self.trees) / max(average_path(self.size), 1e-9))


def drawn(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` of the rows, each as likely as any other: those of least hash of the values and a running number among equal rows."""
    xs = [C.quoted(c) for c in rows.columns]
    counts = rows.groupBy(*xs).agg(F.count("*").alias("__n"))
    # frequent values in steps, which are dealt out: neither a long array nor one task for all
    steps = F.explode(F.sequence(F.lit(1).cast("long"), "__n", F.lit(STEP).cast("long"))).alias("__i")
    first = counts.where(F.col("__n") <= STEP).withColumn("__i", F.lit(1).cast("long"))
    every = first.union(counts.where(F.col("__n") > STEP).select(*xs, "__n", steps).repartition(*xs, "__i"))
    every = every.select(*xs, F.explode(F.sequence("__i", F.least(F.col("__i") + STEP - 1, "__n"))).alias("__i"))
    return every.orderBy(F.xxhash64(F.lit(seed), *xs, "__i"), *xs, "__i").limit(most).select(*xs)


def scored(df: DataFrame, names: list[str], seed: int = 42, trees: int = TREES) -> DataFrame:
    """df's rows without nulls in names, with a score; the forest grows from at most trees x SAMPLE rows, drawn in proportion to each value's rows."""
    shipped(df.sparkSession)
    rows = df.select(*(C.quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(names))).dropna()
    xs = [f"x{i}" for i in range(len(names))]
    sample = drawn(rows, trees * SAMPLE, seed).toPandas().to_numpy(dtype=float)
    if len(sample) < LEAST_ROWS:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    grown = Forest(sample, seed, trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=grown.score(b.to_numpy(dtype=float)))

    return rows.mapInPandas(run, ", ".join(f"{x} double" for x in xs) + ", score double")


def flagged(df: DataFrame, names: list[str], contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """scored() with is_outlier: scores beyond the quantile that the contamination sets."""
    rows = scored(df, names, seed)
    bound = rows.agg(F.percentile("score", F.lit(1 - contamination)).alias("bound"))
    return rows.crossJoin(F.broadcast(bound)).withColumn("is_outlier", F.col("score") > F.col("bound")).drop("bound")


def univariate(df: DataFrame, column: str, contamination: float = 0.05, seed: int = 42) -> dict[str, Any]:
    """Counts for one column; extreme ones are beyond the contamination's fifth part as well."""
    rows = scored(C.normalised(df), [column], seed)
    got = rows.agg(F.count("*"), F.percentile("score", F.array(F.lit(1 - contamination), F.lit(1 - contamination / 5)))).first()
    out = {"column_name": column, "n": got[0], "outlier_count": 0, "outlier_ratio": 0.0, "extreme_count": 0, "method": "isolation_forest", "contamination": contamination}
    if got[0]:
        hits = rows.agg(F.count_if(F.col("score") > got[1][0]), F.count_if(F.col("score") > got[1][1])).first()
        out |= {"outlier_count": hits[0], "outlier_ratio": hits[0] / got[0], "extreme_count": hits[1]}
    return out


def standardised(df: DataFrame) -> DataFrame:
    """Rows without nulls, each column less its mean and over its population deviation."""
    rows = df.select(*(C.quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(df.columns))).dropna()
    xs = rows.columns
    stats = rows.agg(*(F.avg(x).alias(f"a{x}") for x in xs), *(F.stddev_pop(x).alias(f"s{x}") for x in xs))
    return rows.crossJoin(F.broadcast(stats)).select(*(F.coalesce(F.try_divide(F.col(x) - F.col(f"a{x}"), F.nullif(f"s{x}", F.lit(0.0))), F.lit(0.0)).alias(x) for x in xs))


def multivariate_df(df: DataFrame, contamination: float = 0.05, seed: int = 42, most_rows: int | None = None) -> DataFrame:
    """flagged() over all of df's columns, standardised; most_rows draws so many rows by a hash, as a bounded sample."""
    rows = C.normalised(df)
    if most_rows:
        rows = drawn(rows.dropna(), most_rows, seed)
    rows = standardised(rows)
    return flagged(rows, rows.columns, contamination, seed)


def multivariate_count(df: DataFrame, contamination: float, seed: int, most_rows: int) -> int:
    if len(df.columns) < 2:
        return 0
    return multivariate_df(df, contamination, seed, most_rows).where("is_outlier").count()
