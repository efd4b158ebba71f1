"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Shallow trees are boosted on the labelled sample; every path from a root to a
node is a conjunction of bounds on statistics, that is a rule; a logistic
regression with an L1 penalty weighs the rules and drops most of them. What is
left is one column expression: the logistic function of a sum of CASEs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import vectext as vt

#: Labelled rows that the fit takes at most, drawn by a hash of their id.
MOST_LABELS = 20_000
THRESHOLD = 0.3

STATISTICS = ["log_words", "word_length", "capitals", "symbols", "marks", "bars", "digits", "stops", "lines", "line_words", "distinct_words", "same_neighbours", "repeated_windows", "loud_words", "line_ends", "wide"]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; those of a text without words are 0."""
    data, offsets = vt.buffers(column)
    starts, ends, first = vt.words(data, offsets, vt.NON_SPACE)

    def by_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def by_word(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[first[1:]] - total[first[:-1]]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    one_of = lambda s: np.isin(data, np.frombuffer(s.encode(), np.uint8))
    n = np.diff(first)
    size = by_text((data & 0xC0) != 0x80)
    capital = (data >= 65) & (data <= 90)
    letters = by_text(capital | (data >= 97) & (data <= 122))
    chars = by_word(ends - starts)
    h = vt.span_hashes(data, starts, ends)
    own = vt.owners(first)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    distinct = np.zeros(len(n), np.int64)
    for i in range(len(n)):
        distinct[i] = len(np.unique(h[first[i] : first[i + 1]]))
    w, at = vt.window_hashes(h, first, 3)
    bounds = np.searchsorted(at, first)
    again = np.zeros(len(n), np.int64)
    for i in range(len(n)):
        part = w[bounds[i] : bounds[i + 1]]
        again[i] = len(part) - len(np.unique(part))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    newline = data == 10
    lines = by_text(newline) + 1
    before = np.zeros(len(data), bool)
    before[:-1] = newline[1:]
    ended = by_text(before & one_of(".!?"))
    loud = np.isin(last, np.frombuffer(b"!#*$%&", np.uint8))
    columns = [
        np.log1p(n), share(chars, n), share(by_text(capital), letters), share(by_text(one_of("#*$%&<>")), size), share(by_text(one_of("!")), n), share(by_text(one_of("|")), n),
        share(by_text((data >= 48) & (data <= 57)), size), share(by_text(one_of(".")), n), np.log1p(lines), share(n, lines), share(distinct, n), share(by_word(same), n), share(again, n), share(by_word(loud), n), share(ended, lines), share(by_text(data >= 0xC2), size),
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[n == 0] = 0
    return out


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one column for each of STATISTICS) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vt.pieces(batches):
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc_id", *STATISTICS])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in STATISTICS))


#: Bounds on statistics: (index, bound, above) each, all of which must hold.
Rule = tuple[tuple[int, float, bool], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (x[:, k] > v if above else x[:, k] <= v for k, v, above in rule))


@dataclass
class RuleEnsemble:
    """Rules with weights, and an intercept; score() as a column or on a matrix."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            condition = reduce(Column.__and__, (F.col(STATISTICS[k]) > v if above else F.col(STATISTICS[k]) <= v for k, v, above in rule))
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _tree(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, depth: int, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """Splits where the squared error of target falls most; leaves add their mean to step."""
    best = (1e-9, None)
    if depth and len(rows) >= 20:
        y = target[rows]
        total, n = y.sum(), len(rows)
        for k in columns:
            place = np.searchsorted(cuts[k], x[rows, k], "left")
            counts = np.cumsum(np.bincount(place, minlength=len(cuts[k]) + 1))[:-1]
            sums = np.cumsum(np.bincount(place, y, minlength=len(cuts[k]) + 1))[:-1]
            ok = (counts >= 5) & (n - counts >= 5)
            gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (k, float(cuts[k][gain.argmax()])))
    if best[1] is None:
        step[rows] = target[rows].mean()
        return
    k, v = best[1]
    for above in (False, True):
        part = rows[(x[rows, k] > v) == above]
        rule = (*path, (int(k), v, above))
        out.append(rule)
        _tree(x, target, cuts, part, columns, depth - 1, rule, out, step)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> RuleEnsemble:
    """Rules of boosted trees, weighed by a lasso logistic regression (accelerated proximal gradient).

    With one class or none in y, the score is that class's share, smoothed.
    """
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return RuleEnsemble(prior)
    rnd = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 48))) for k in range(x.shape[1])]
    margin = np.full(len(x), prior)
    found: list[Rule] = []
    for _ in range(trees):
        rows = rnd.permutation(len(x))[: max(40, len(x) // 2)]
        columns = rnd.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        step = np.zeros(len(x))
        own: list[Rule] = []
        _tree(x, y - 1 / (1 + np.exp(-margin)), cuts, rows, columns, depth, (), own, step)
        # the tree's step for all rows: leaves are the rules that no other rule of the tree extends
        leaves = [r for r in own if not any(len(o) > len(r) and o[: len(r)] == r for o in own)]
        for r in leaves:
            inside = holds(r, x)
            hit = inside[rows]
            margin[inside] += 2.0 * step[rows][hit].mean() if hit.any() else 0
        found += own
    kept, seen = [], set()
    for r in found:
        column = holds(r, x)
        key = column.tobytes()
        if 0.002 < column.mean() < 0.998 and key not in seen:
            seen.add(key)
            kept.append((r, column))
    if not kept:
        return RuleEnsemble(prior)
    a = np.stack([c for _, c in kept], axis=1).astype(np.float64)
    scale = np.maximum(a.std(axis=0), 1e-6)
    centre = a.mean(axis=0)
    z = (a - centre) / scale
    limit = 0.25 * np.linalg.norm(z, 2) ** 2 / len(z) + 0.25
    w, b = np.zeros(z.shape[1]), prior
    vw, vb, t = w, b, 1.0
    for _ in range(400):
        error = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - z.T @ error / len(y) / limit
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / limit, 0)
        nb = vb - error.mean() / limit
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(float(b - (w * centre / scale).sum()), [(kept[k][0], float(w[k] / scale[k])) for k in used])


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labels: int = MOST_LABELS) -> RuleEnsemble:
    """Fits on labelled rows only: at most most_labels of them, drawn by a hash of doc_id.

    Rows with a null id or label are left out, and an id's labels are averaged
    and rounded. Of an id on several rows the one of least statistics counts,
    so that a fit does not depend on the order of rows. Only these rows' texts
    are read into the fit.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label_col)).cast("double").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    sample = described(docs.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "s.*").join(F.broadcast(wanted), "doc_id").orderBy("doc_id").select("y", *STATISTICS).toArrow()
    x = np.stack([sample[c].to_numpy() for c in STATISTICS], axis=1) if sample.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, sample["y"].to_numpy()) if sample.num_rows else RuleEnsemble()


def scored(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row. Null and empty texts get the score of statistics that are all 0."""
    rows = described(docs, id_col, text_col).select("doc_id", model.column().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """The fifth of ids that no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return scored(docs, trained(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
