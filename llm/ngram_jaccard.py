"""N-gram Jaccard join: an exact self-join of documents on the Jaccard distance of their word shingles.

The Jaccard distance is a metric, and the join is one of metric spaces:
pivots open regions, a document goes to its own region and, by a window, to
each other region that may hold a document within the radius; regions join
on their own, recursively where they are large.

Pivots come in two levels. Documents drawn as pivots cannot part a corpus:
nearly all distances are 1, so that every window holds every pivot. The first
level therefore takes the points {s}, sets of one shingle: the pivots nearest
to a document are its own shingles, all equally near, and ties are broken by
one order of all shingles, rare ones first. Two documents within the radius
differ in few shingles, so the window of a document is a short prefix of
its shingles in that order: of its first n - ceil(0.8 n) + k shingles, k at
least are shared with any document within the radius. Each such pivot hands its
region to its least document, the leader, so that the regions of a group of
near copies fall together. A document that shares too few of its pivots stands
in no region, and one that shares few of them in a leader's region, not there. Within a leader's region the second level
draws documents as pivots: there the distances differ, and the windows
d(x, q) <= d(x, p) + 2 r of Voronoi regions apply, recursively. What falls
into a pivot's ball is linked to it and needs no tests among itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import vectext as vt
from llm.shared import components, named, stashed

#: Buckets of shingles in the table that orders them: 2^20 at any size of the corpus, 1 MB for each worker.
SKETCH_BITS, SKETCH_BLOCK = 20, 14
#: The filter of documents that stand in some region has 12 bits for each of them, and 64 MB at most.
FILTER_BITS, MOST_FILTER_WORDS = 12, 1 << 23
#: Pivots of a bucket 2^(24 / 4) times as full as the mean are dealt in parts.
HOT_LEVEL, HOT_PARTS = 24, 64
#: A region is dealt as pairs of blocks: of BLOCK_SHINGLES, up to a few blocks; beyond that of REGION_SHINGLES,
#: as each set goes to as many tasks as its region has blocks.
BLOCK_SHINGLES, FEW_BLOCKS, REGION_SHINGLES = 40_000, 8, 3_000_000
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the bounds of each text's.

    A text of fewer words than width has its whole sequence as one shingle.
    """
    data = vt.lowered(data)
    starts, ends, first = vt.words(data, offsets, vt.NON_SPACE)
    h = vt.span_hashes(data, starts, ends)
    w, at = vt.window_hashes(h, first, width)
    counts = np.diff(first)
    own = vt.owners(first)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), _U)
        for k, t in enumerate(short):
            x = _U(int(counts[t]))
            for v in h[first[t] : first[t + 1]]:
                x = vt.mixed(np.array([x], _U))[0] ^ v
            extra[k] = vt.mixed(np.array([x], _U))[0]
        w, own = np.concatenate([w, extra]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        w, own = w[order], own[order]
    bounds = np.searchsorted(own, np.arange(len(offsets)))
    for i in range(len(bounds) - 1):
        w[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (own[1:] != own[:-1])
    return w[keep], np.searchsorted(own[keep], np.arange(len(offsets)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in vt.pieces(batches):
        data, offsets = vt.buffers(batch.column(0))
        data = vt.lowered(data)
        starts, ends, first = vt.words(data, offsets, vt.NON_SPACE)
        w, _ = vt.window_hashes(vt.span_hashes(data, starts, ends), first, width)
        total += np.bincount((w >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
    for k, part in enumerate(total.reshape(-1, 1 << SKETCH_BLOCK)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(x, 8 << SKETCH_BLOCK, "zstd", asbytes=True), np.int64)
            total[k] = total[k] + part if k in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in total.values()], pa.binary())], ["block", "counts"])


def frequency_levels(docs: DataFrame, width: int) -> bytes:
    """For each of 2**20 buckets of shingles, how frequent they are about (log2).

    It fixes the order of shingles; any order gives the same links, a good one
    keeps frequent passages out of the windows: those that fill a bucket more
    by a fifth are told from rare ones. Its size never grows.
    """
    rows = docs.select("text").mapInArrow(lambda it: _sketch(it, width), "block int, counts binary").repartition("block").mapInArrow(_summed, "block int, counts binary")
    n = np.zeros((1 << SKETCH_BITS - SKETCH_BLOCK, 1 << SKETCH_BLOCK), np.int64)
    for r in rows.collect():
        n[r["block"]] = np.frombuffer(pa.decompress(bytes(r["counts"]), 8 << SKETCH_BLOCK, "zstd", asbytes=True), np.int64)
    # relative to the mean, so that the levels tell rare from frequent at any size of the corpus
    return np.clip(np.floor(4 * np.log2((n + 1) / (n.mean() + 1))), 0, 63).astype(np.uint8).tobytes()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def spare(n: int, percent: int) -> int:
    """Shingles of n that a document within the radius may lack."""
    return n - (percent * n + 99) // 100


def sure(n: int, percent: int) -> int:
    """Shared shingles that the window is long enough for; never falls as n grows."""
    return max(1, spare(n, percent) // 2)


def _described(batches: Iterator[pa.RecordBatch], width: int, percent: int, levels: bytes | None) -> Iterator[pa.RecordBatch]:
    """Each text's set as its size and two hashes and, where levels order the shingles, its window: 6 bytes a pivot."""
    level = np.frombuffer(levels, np.uint8).astype(_U) << _U(42) if levels else None
    for batch in vt.pieces(batches):
        data, offsets = vt.buffers(batch.column(1))
        w, bounds = shingles(data, offsets, width)
        n = np.diff(bounds)
        out = [None] * len(n)
        if level is not None:  # 48 bits of a shingle: should two share them, their regions are one
            key = level[(w >> _U(64 - SKETCH_BITS)).astype(np.int64)] | (w >> _U(22))
            for i in range(len(n)):
                k = key[bounds[i] : bounds[i + 1]]
                k.sort()
                k = k[: spare(len(k), percent) + sure(len(k), percent)]
                out[i] = k.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(n, pa.int64()), _signed(_sums(vt.mixed(w ^ _U(0x5851F42D4C957F2D)), bounds)), _signed(_sums(vt.mixed(w ^ _U(0x14057B7EF767814F)), bounds)), pa.array(out, pa.binary())],
            ["doc_id", *batch.schema.names[2:], "n_shingles", "set_id", "set_id2", "prefix"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = vt.buffers(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        pivot = np.zeros((len(data) // 6, 8), np.uint8)
        pivot[:, :6] = data.reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([pa.array(pivot.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, np.diff(offsets) // 6))], ["pivot", "set_id"])
    vt.released()


def _bit(doc_id: np.ndarray) -> np.ndarray:
    return vt.mixed(doc_id.view(_U) + _U(0x632BE59BD9B4E019))


def _bits(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.unique(_bit(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))) % _U(64 * words))
        word, head = np.unique(h >> _U(6), return_index=True)
        bits = np.bitwise_or.reduceat(_U(1) << (h & _U(63)), head) if len(h) else h
        yield pa.RecordBatch.from_arrays([_signed(word), _signed(bits)], ["word", "bits"])


def _filter(reps: DataFrame) -> np.ndarray:
    """A table of bits that holds every rep, and few others as long as it may grow."""
    words = 1 << 10
    n = reps.count()
    while words < MOST_FILTER_WORDS and 64 * words < FILTER_BITS * n:
        words *= 2
    found = reps.mapInArrow(lambda it: _bits(it, words), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(_U)


def _sets(batches: Iterator[pa.RecordBatch], width: int, table) -> Iterator[pa.RecordBatch]:
    bits = table.value

    def wanted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _bit(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))) % _U(64 * len(bits))
            hit = (bits[(h >> _U(6)).astype(np.int64)] >> (h & _U(63))) & _U(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    for batch in vt.pieces(wanted()):
        data, offsets = vt.buffers(batch.column(1))
        w, bounds = shingles(data, offsets, width)
        ids = _signed(_sums(vt.mixed(w ^ _U(0x5851F42D4C957F2D)), bounds))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([w[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)], pa.binary())], ["rep", "set_id", "shingles"])


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        """Whether the two were apart before."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class Region:
    """The sets of one region and their links, as a forest.

    Pivots are drawn farthest first, and each set belongs to the Voronoi region
    of its nearest one, or, at 1 - r or more from all, to the region of the far
    ones. Windows take it to each other region that may hold a set within the
    radius r: to a pivot's, if d(x, q) is at most d(x, p) + 2 r and at most the
    region's own reach + r; to the far ones', if d(x, p) is 1 - 2 r or more.
    Regions are parted again as long as that saves comparisons: the squares of
    the windows' sizes and the distances to pivots add up to less than the
    square of the region's. So no region ever costs more than all its pairs.
    In one of up to PIVOTS sets each becomes a pivot, and all links are its ball's.
    """

    PIVOTS, TILE, COLUMNS = 12, 2048, 2048

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        self.percent, self.radius = percent, 1 - percent / 100
        flat = np.concatenate(sets)
        _, local, df = np.unique(flat, return_inverse=True, return_counts=True)
        own = np.repeat(np.arange(len(sets)), self.n)
        keep = df[local] > 1  # what only one set has adds nothing to an intersection
        self.local, own = local[keep], own[keep]
        self.universe, self.bounds = len(df), np.searchsorted(own, np.arange(len(sets) + 1))
        self.forest = _Forest(len(sets))
        self.by_pivot = self.by_pair = self.offered = 0  # links found by pivots and pair by pair, and pairs offered

    def join(self) -> list[tuple[int, int]]:
        work = [np.arange(len(self.n))]
        while work:
            work.extend(self._parted(work.pop()))
        return [(i, r) for i in range(len(self.n)) if (r := self.forest.find(i)) != i]

    def _rows(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles of the members, which member each is of, and the bounds of each member's."""
        size = self.bounds[members + 1] - self.bounds[members]
        bounds = np.zeros(len(members) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        at = np.repeat(self.bounds[members] - bounds[:-1], size) + np.arange(bounds[-1])
        return self.local[at], np.repeat(np.arange(len(members)), size), bounds

    def _linked(self, common: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
        return 100 * common >= self.percent * (n + m - common)

    def _parted(self, members: np.ndarray) -> list[np.ndarray]:
        """Links found by this region's pivots, and the windows that are left to join."""
        roots = {self.forest.find(x) for x in members.tolist()}
        if len(roots) == 1:
            return []
        local, own, bounds = self._rows(members)
        n, flag = self.n[members], np.zeros(self.universe, bool)
        nearest, far, p = np.full(len(members), np.inf), [], 0
        for _ in range(self.PIVOTS):
            mine = local[bounds[p] : bounds[p + 1]]
            flag[mine] = True
            common = np.bincount(own[flag[local]], minlength=len(members))
            common[p] = n[p]
            flag[mine] = False
            far.append(1 - common / (n + n[p] - common))
            for x in members[self._linked(common, n, n[p])].tolist():
                self.by_pivot += self.forest.tie(int(members[p]), x)
            nearest = np.minimum(nearest, far[-1])
            p = int(nearest.argmax())
            if nearest[p] <= 0:
                return []
        d = np.stack(far)
        owner = np.where(nearest >= 1 - self.radius - 1e-9, len(far), d.argmin(axis=0))
        windows = [nearest >= 1 - 2 * self.radius - 1e-9] if (owner == len(far)).any() else []
        for k in range(len(far)):
            mine = owner == k
            if mine.any():
                windows.append(mine | (d[k] <= np.minimum(nearest + 2 * self.radius, d[k][mine].max() + self.radius) + 1e-9))
        size = np.array([w.sum() for w in windows])
        if (size * size).sum() + d.size >= len(members) ** 2:  # these pivots part nothing here
            return self._every(members, local, own, bounds)
        return [members[w] for w in windows if w.sum() > 1]

    def _every(self, members: np.ndarray, local: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Compares all pairs: by the lists of sets that have a shingle, or where these are long by products of matrices."""
        m = len(members)
        self.offered += m * (m - 1) // 2
        _, column, df = np.unique(local, return_inverse=True, return_counts=True)
        if not len(df):
            return []
        tie = lambda x, y: self.forest.tie(int(members[x]), int(members[y]))
        n = self.n[members]
        if m * m * len(df) < 200 * int((df * df).sum()):
            for i in range(0, m, self.TILE):
                for j in range(i, m, self.TILE):
                    common = self._product(column, own, bounds, i, j, len(df), m)
                    rows, columns = common.shape
                    for x, y in zip(*np.nonzero(100 * common >= self.percent * (n[i : i + rows, None] + n[None, j : j + columns] - common)), strict=True):
                        if i + x < j + y:
                            self.by_pair += tie(i + x, j + y)
            return []
        order = np.argsort(column, kind="stable")
        holders = own[order]
        start = np.zeros(len(df) + 1, np.int64)
        np.cumsum(df, out=start[1:])
        for x in range(m - 1):
            mine = column[bounds[x] : bounds[x + 1]]
            size = df[mine]
            total = np.cumsum(size)
            if len(total):
                at = np.repeat(start[mine] - total + size, size) + np.arange(total[-1])
                common = np.bincount(holders[at], minlength=m)[x + 1 :]
                for y in np.flatnonzero(self._linked(common, n[x + 1 :], n[x])).tolist():
                    self.by_pair += tie(x, x + 1 + y)
        return []

    def _product(self, column: np.ndarray, own: np.ndarray, bounds: np.ndarray, i: int, j: int, width: int, m: int) -> np.ndarray:
        """Sizes of the intersections of the members of one tile with those of another."""
        parts = []
        for low in (i, j):
            high = min(low + self.TILE, m)
            span = slice(bounds[low], bounds[high])
            order = np.argsort(column[span], kind="stable")
            parts.append((column[span][order], own[span][order] - low, high - low))
        common = np.zeros((parts[0][2], parts[1][2]), np.float32)
        for c in range(0, width, self.COLUMNS):
            dense = []
            for columns, rows, height in parts:
                a, b = np.searchsorted(columns, [c, c + self.COLUMNS])
                x = np.zeros((height, min(self.COLUMNS, width - c)), np.float32)
                x[rows[a:b], columns[a:b] - c] = 1
                dense.append(x)
            common += dense[0] @ dense[1].T
        return common


def _joined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links within regions; the rows come sorted by region, and a region may span batches."""
    now, ids, sets = None, [], []
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(ids) > 1:
            out.extend((ids[a], ids[b]) for a, b in Region(sets, percent).join())

    for batch in batches:
        regions = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        members = batch.column(3).to_pylist()
        for k, region in enumerate(regions):
            if region != now:
                close()
                now, ids, sets = region, [], []
            if not ids or ids[-1] != members[k]:  # a repeated row
                ids.append(members[k])
                sets.append(np.frombuffer(batch.column(4)[k].as_buffer(), _U))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
            out.clear()
    close()
    sets.clear()
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
    vt.released()


def leaders(windows: DataFrame) -> DataFrame:
    """(set_id, leader, n) of windows (pivot, set_id): the pivots, of two sets or more, that each set has in common with each leader, the least set of the pivot's.

    Pivots of full buckets, which the number of a pivot tells, are dealt in
    parts, led each by its least set first, so that no pivot is one task's.
    """
    hot = F.shiftright("pivot", 42) >= HOT_LEVEL
    by_pivot = Window.partitionBy("pivot")
    cold = windows.where(~hot).select("set_id", F.min("set_id").over(by_pivot).alias("leader"), F.count("*").over(by_pivot).alias("m"))
    parted = windows.where(hot).withColumn("part", F.pmod(F.xxhash64("set_id"), F.lit(HOT_PARTS)))
    parts = parted.groupBy("pivot", "part").agg(F.min("set_id").alias("leader"), F.count("*").alias("m"))
    heads = parts.groupBy("pivot").agg(F.min("leader").alias("leader"), F.sum("m").alias("m"))
    led = parted.join(parts.select("pivot", "part").join(heads, "pivot"), ["pivot", "part"]).select("set_id", "leader", "m")
    return cold.union(led).where("m > 1").groupBy("set_id", "leader").agg(F.count("*").alias("n"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", region_shingles: int = REGION_SHINGLES, block_shingles: int = BLOCK_SHINGLES, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, plus the columns in keep) for every row of docs.

    Words are the runs without ASCII space of the text with A-Z lower-cased;
    two documents link when their sets of width-word shingles have a Jaccard
    similarity of percent / 100 or more; component_id is the least id that
    links reach. Sets are compared by 64-bit hashes of their shingles.

    Null or blank texts have no shingles and link with nothing. Rows with a
    null id are returned with a null component unless an equal set has an id;
    they link nothing else. Rows of one id with different texts each get their
    own text's component. Repeated rows are returned as often as they come.
    Ties cannot change a component. Other columns of docs are ignored, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kept = [f"k{i}" for i in range(len(keep or []))]
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"), *(named(c).alias(k) for c, k in zip(keep or [], kept, strict=True)))
    levels = frequency_levels(rows, width)
    extra = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[2:])
    columns = "n_shingles long, set_id long, set_id2 long, prefix binary"
    windowed = rows.select("doc_id", "text").mapInArrow(lambda it: _described(it, width, percent, levels), f"doc_id long, {columns}")
    described = stashed(rows.mapInArrow(lambda it: _described(it, width, percent, None), f"doc_id long, {extra}{columns}").drop("prefix"))
    one_of_each = lambda df, *more: df.where("n_shingles > 0 and doc_id is not null").groupBy("set_id", "set_id2", "n_shingles").agg(F.min("doc_id").alias("rep"), *more)
    sets = one_of_each(described)

    # first level: the leaders of each set's pivots, and how many pivots each leads
    windows = one_of_each(windowed, F.first("prefix").alias("prefix")).select("set_id", "prefix").mapInArrow(_windows, "pivot long, set_id long")
    by_set = Window.partitionBy("set_id")
    led = leaders(windows).withColumn("all", F.sum("n").over(by_set)).withColumn("leaders", F.count("*").over(by_set))
    # The least partner has ceil(0.8 n) shingles, and so many pivots at least are shared with a document within the
    # radius. They fall to at most `leaders` regions, so that one region both stand in has its part of them from both.
    n = F.expr(f"({percent} * n_shingles + 99) div 100")
    needed = F.greatest(F.lit(1), F.floor((n - F.floor((n * percent + 99) / 100)) / 2))
    regions = led.join(sets.select("set_id", "rep", "n_shingles"), "set_id").where((F.col("all") >= needed) & (F.col("n") * F.col("leaders") >= needed)).select("leader", "set_id", "rep", "n_shingles")
    weights = (regions := stashed(regions)).groupBy("leader").agg(F.least(F.ceil(F.sum("n_shingles") / block_shingles), FEW_BLOCKS + F.ceil(F.sum("n_shingles") / region_shingles)).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    regions = regions.join(weights, "leader").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))

    # the sets of the documents that stand in some region; a filter spares the others
    table = spark.sparkContext.broadcast(_filter(regions.select("rep").distinct()))
    texts = rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(lambda it: _sets(it, width, table), "rep long, set_id long, shingles binary")
    regions = regions.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    regions = regions.select("leader", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "set_id", "rep")
    members = regions.join(texts, ["rep", "set_id"]).select("leader", "low", "high", "set_id", "shingles")
    links = members.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high", "set_id").mapInArrow(lambda it: _joined(it, percent), "a long, b long")

    # components of sets, then their least document; texts without shingles stay out of the join
    of_set = components(links)
    members = sets.select("set_id", "set_id2", "rep").join(of_set.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    members = members.join(members.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("set_id", "set_id2", "component_id")
    some, none = described.where("n_shingles > 0"), described.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = some.join(members, ["set_id", "set_id2"], "left").select(*none.columns).union(none)
    return out.select("doc_id", "n_shingles", "component_id", *(F.col(k).alias(c) for c, k in zip(keep or [], kept, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS x FROM d
),
f AS (SELECT doc_id, unnest(x) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.x) + len(q.x) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, m.b AS component_id FROM s JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = s.doc_id
"""
