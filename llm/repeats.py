"""Removal of repeated byte strings: suffixes sorted by most-significant-digit passes, no deeper than the threshold.

Two suffixes share their first `length` bytes if and only if a radix sort that
stops at that depth leaves them in one group, so the groups it ends with are
the repeated windows. To sort every suffix of a corpus would move it a dozen
times over; the first digits are therefore dealt out by Spark, and few
suffixes go further.

The first digit: each window of `length` bytes belongs to its anchor, the gram
of least hash among its grams of GRAM bytes (the leftmost among equals). Equal
windows have equal anchors at equal offsets, so windows are dealt by anchor,
about two rows in length - GRAM + 2 bytes. The second digit is the whole
stretch of text that an anchor's windows cover, as a hash: where it is equal,
all windows are, and all but the first of them are settled. Only where one
anchor has several stretches, at the rims of copies, do the windows
themselves go through the remaining passes, DIGIT bytes a pass; groups of one
fall out after each.

Texts that equal an earlier text as a whole are settled before all that: their
windows start earlier there. Anchors with very many stretches are split by
document into parts, which pass on what is first in each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import vectext as vt
from llm.shared import stashed

LENGTH = 100
GRAM = 32
DIGIT = 8
#: Stretches of one anchor that one task sorts.
PART = 60_000
#: Windows that go through the passes together.
TOGETHER = 1 << 19
_U = np.uint64
_PLACE = 24  # bits of a place within a block of text


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    eights = np.zeros(len(data) - 7, _U)
    for k in range(8):
        eights |= data[k : k + len(eights)].astype(_U) << _U(8 * k)
    h = np.zeros(n, _U)
    for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h = vt.mixed(h ^ eights[k : k + n]) + _U(0x9E3779B97F4A7C15)
    return vt.mixed(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all texts: anchors as text, place and hash, and the first and last window that each owns.

    Places are in data. Windows never leave their text.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, _U), none, none
    width = length - gram + 1
    parts = []
    step = (1 << _PLACE) - 2 * length
    for low in range(0, len(data) - length + 1, step):
        piece = data[low : low + step + length - 1]
        h = _gram_hashes(piece, gram)
        n = len(h) - width + 1
        key = (h >> _U(_PLACE)) << _U(_PLACE) | np.arange(len(h), dtype=_U)
        x = np.concatenate([key, np.full(-len(h) % width, ~_U(0), _U)]).reshape(-1, width)
        upto = np.minimum.accumulate(x, axis=1).reshape(-1)
        onward = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(onward[:n], upto[width - 1 : width - 1 + n]) & _U((1 << _PLACE) - 1)).astype(np.int64)
        first = np.ones(n, bool)
        first[1:] = anchor[1:] != anchor[:-1]
        inside = np.ones(n, bool)  # windows within one text
        for edge in offsets[(offsets > low) & (offsets < low + len(piece))] - low:
            inside[max(0, edge - length + 1) : edge] = False
            if edge < n:
                first[edge] = True
        first[1:] |= inside[1:] & ~inside[:-1]
        ends = np.ones(n, bool)
        ends[:-1] = first[1:] | ~inside[1:]
        begin, end = np.flatnonzero(first & inside), np.flatnonzero(ends & inside)
        parts.append((anchor[begin] + low, h[anchor[begin]], begin + low, end + low))
    place, h, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.searchsorted(offsets, begin, "right") - 1, place, h, begin, end


def _pack(place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A window run in one number that sorts by place: place in the text, bytes before it, windows."""
    return place << 16 | (place - begin) << 8 | (end - begin)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = packed >> 16
    begin = place - (packed >> 8 & 0xFF)
    return place, begin, begin + (packed & 0xFF)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in vt.pieces(batches):
        data, offsets = vt.buffers(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        text, place, h, begin, end = anchors(data, offsets, length, gram)
        stretch = vt.span_hashes(data, begin, end + length)
        base = offsets[text]
        packed, own = _pack(place - base, begin - base, end - base), ids[text]
        # of equal stretches in one batch only the first is dealt by its gram; the later ones, settled, go anywhere
        order = np.lexsort((packed, own, stretch, h))
        h, stretch, own, packed = h[order], stretch[order], own[order], packed[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (stretch[1:] != stretch[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeated_row = ~new & (own == own[first]) & (packed == packed[first])
        h = np.where(new, h, vt.mixed(own.view(_U) + packed.view(_U)))
        packed = np.where(new, packed, ~packed)
        keep = ~repeated_row
        for column in np.array_split(np.flatnonzero(keep), max(1, len(h) // 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(h[column].view(np.int64)), pa.array(stretch[column].view(np.int64)), pa.array(own[column]), pa.array(packed[column])], ["gram", "stretch", "id", "packed"])


def _settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, stretch, id and place: later ones of a stretch as removed bytes, first ones of an anchor with several stretches as open."""
    last = None  # the first row of the stretch at hand: gram, stretch, id, packed, and whether it went out

    def rows(removed: tuple, opened: tuple) -> pa.RecordBatch:
        (ids, packed), (grams, more, places) = removed, opened
        _, begin, end = _unpack(packed)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, more])), pa.array(np.concatenate([begin, places])), pa.array(np.concatenate([end + length, np.full(len(more), -1, np.int64)])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), grams]))],
            ["id", "begin", "stop", "gram"],
        )

    for batch in batches:
        g, s, i, p = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
        done = p < 0
        if done.any():
            yield rows((i[done], ~p[done]), (i[:0], i[:0], i[:0]))
            g, s, i, p = g[~done], s[~done], i[~done], p[~done]
        if not len(g):
            continue
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        if last is not None:
            new[0] = (g[0], s[0]) != (last[0], last[1])
        firsts = np.flatnonzero(new)
        # the first row of each row's stretch
        owner = np.cumsum(new) - 1
        fi, fp = i[firsts], p[firsts]
        if not new[0]:
            fi, fp = np.concatenate([[last[2]], fi]), np.concatenate([[last[3]], fp])
            owner = owner + 1
        later = ~new & ((i != fi[owner]) | (p != fp[owner]))
        # firsts whose neighbour among firsts has the same gram
        fg = g[firsts]
        prior = last is not None
        allg = np.concatenate([[last[0]] if prior else np.zeros(0, np.int64), fg]).astype(np.int64)
        alli = np.concatenate([[last[2]] if prior else np.zeros(0, np.int64), i[firsts]]).astype(np.int64)
        allp = np.concatenate([[last[3]] if prior else np.zeros(0, np.int64), p[firsts]]).astype(np.int64)
        same = np.zeros(len(allg) + 1, bool)
        same[1:-1] = allg[1:] == allg[:-1]
        opened = same[:-1] | same[1:]
        if prior:
            went = last[4]
            opened[0] &= not went
            went_last = opened[0] | went if len(allg) == 1 else opened[-1]
        else:
            went_last = opened[-1]
        if len(allg):
            last = (allg[-1], s[firsts[-1]] if len(firsts) else last[1], alli[-1], allp[-1], bool(went_last))
        yield rows((i[later], p[later]), (allg[opened], alli[opened], allp[opened]))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that each open anchor's windows cover."""
    for batch in batches:
        texts = batch.column(1)
        out: tuple[list, ...] = ([], [], [], [], [])
        for r in range(batch.num_rows):
            raw = texts[r].as_buffer() if texts[r].is_valid else None
            for x in batch.column(2)[r].as_py():
                _, begin, end = _unpack(np.int64(x["packed"]))
                if raw is None or end + length > raw.size:
                    continue
                for column, v in zip(out, (x["gram"], x["part"], batch.column(0)[r].as_py(), x["packed"], raw[int(begin) : int(end) + length].to_pybytes()), strict=True):
                    column.append(v)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["gram", "part", "id", "packed", "bytes"])
                out = ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["gram", "part", "id", "packed", "bytes"])


def _radix(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the windows of the rows (group, id, packed, bytes), each group's in order of id and place, by most-significant-digit passes.

    Groups of one fall out after each pass, and those left at last are equal
    windows, byte by byte. Returns row and start of every window, and whether an equal one comes before.
    """
    blob = np.frombuffer(b"".join(r[3] for r in rows) + bytes(DIGIT), np.uint8)
    size = np.array([len(r[3]) for r in rows])
    base = np.cumsum(size) - size
    count = size - length + 1
    row = np.repeat(np.arange(len(rows)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    back = np.array([r[2] >> 8 & 0xFF for r in rows])
    group = np.array([r[0] for r in rows])
    at = base[row] + k
    digits = np.zeros(len(blob) - DIGIT + 1, _U)  # the first byte counts most, as in the order of strings
    for b in range(DIGIT):
        digits |= blob[b : b + len(digits)].astype(_U) << _U(8 * (DIGIT - 1 - b))
    # equal windows lie alike around their anchor
    label = pd.factorize((group[row] << 8) + (k - back[row] + 128))[0].astype(np.int64)
    live = np.arange(len(row))
    for d in range(0, length, DIGIT):
        kept = np.bincount(label)[label] > 1
        live, label = live[kept], label[kept]
        # within its group each window goes to its digit's place; equal ones stay in order of id and place
        key = digits[at[live] + min(d, length - DIGIT)]
        order = np.lexsort((key, label))
        live, label, key = live[order], label[order], key[order]
        new = np.ones(len(live), bool)
        new[1:] = (label[1:] != label[:-1]) | (key[1:] != key[:-1])
        label = np.cumsum(new) - 1
    repeated = np.zeros(len(row), bool)
    repeated[live[1:][label[1:] == label[:-1]]] = True
    return row, k, repeated


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, part, id and place: removed bytes; and, of split anchors, the windows first in their part."""
    rows: list[tuple] = []
    now, group, size = None, 0, 0

    def close() -> pa.RecordBatch:
        row, k, repeated = _radix([r[:4] for r in rows], length)
        ids = np.array([r[1] for r in rows], np.int64)
        begin = np.array([(r[2] >> 16) - (r[2] >> 8 & 0xFF) for r in rows], np.int64)
        start = begin[row] + k
        again = np.flatnonzero(repeated)
        # neighbouring windows of one row as one run of bytes
        cut = np.ones(len(again), bool)
        cut[1:] = (row[again[1:]] != row[again[:-1]]) | (k[again[1:]] != k[again[:-1]] + 1)
        head = again[cut]
        tail = again[np.append(np.flatnonzero(cut)[1:], len(again)) - 1] if len(again) else again
        columns = [ids[row[head]], start[head], start[tail] + length]
        split = np.array([r[4] for r in rows], bool)
        first = np.flatnonzero(split[row] & ~repeated)
        if len(first):
            keys = [hashlib.blake2b(rows[row[x]][3][k[x] : k[x] + length], digest_size=16).digest() for x in first.tolist()]
        else:
            keys = []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([columns[0], ids[row[first]]])), pa.array(np.concatenate([columns[1], start[first]])), pa.array(np.concatenate([columns[2], start[first] + length])), pa.array([None] * len(head) + keys, pa.binary())],
            ["id", "begin", "stop", "window"],
        )

    for batch in batches:
        g, part, ids, packed, raw = (c.to_pylist() for c in batch.columns)
        for i in range(len(g)):
            if (g[i], part[i]) != now:
                if size > TOGETHER:
                    yield close()
                    rows, size = [], 0
                now, group = (g[i], part[i]), group + 1
            if rows and rows[-1][:4] == (group, ids[i], packed[i], raw[i]):  # a repeated row of the table
                continue
            rows.append((group, ids[i], packed[i], raw[i], part[i] >= 0))
            size += len(raw[i]) - length + 1
    if rows:
        yield close()


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, whole, spans = batch.column(1), batch.column(2).to_pylist(), batch.column(3)
        kept, removed, runs = [], [], []
        for r in range(batch.num_rows):
            raw = texts[r].as_buffer().to_pybytes() if texts[r].is_valid else b""
            merged: list[list[int]] = []
            if not whole[r] and len(raw) >= length:  # an equal text has a smaller id
                merged = [[0, len(raw)]]
            elif spans[r].is_valid:
                for b, e in sorted((x["begin"], x["stop"]) for x in spans[r].as_py()):
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    elif b < len(raw):
                        merged.append([b, e])
            last, out = 0, []
            for b, e in merged:
                out.append(raw[last:b])
                last = min(e, len(raw))
            kept.append(b"".join([*out, raw[last:]]))
            removed.append([{"begin": b, "stop": e} for b, e in merged])
            runs.append(len(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.int64()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): each text's bytes less those covered by an earlier string of `length` bytes.

    Texts are UTF-8; a null one is empty. A string is earlier in a document of
    smaller id, or further ahead in the same; overlapping strings count, and
    all are judged on the input. removed lists maximal runs of removed bytes
    (begin, stop); kept are the remaining bytes, which need not be valid UTF-8.
    length may be 40 to 128 and gram 8 to length - 8. A null id counts as the
    least id. Repeated rows (same id, same text) count as one document and
    each get its result; one id should not have different texts. An empty
    table gives an empty result; other columns are ignored.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the first of each group of equal texts
    firsts = rows.select("id", F.md5(F.col("text").cast("binary")).alias("h")).groupBy("h").agg(F.min("id").alias("id")).select("id").distinct()
    texts = rows.repartition("id")
    lone = texts.join(firsts, "id", "left_semi")

    dealt = lone.mapInArrow(lambda it: _anchor_rows(it, length, gram), "gram long, stretch long, id long, packed long")
    dealt = dealt.repartition("gram").sortWithinPartitions("gram", "stretch", "id", "packed")
    settled = dealt.mapInArrow(lambda it: _settled(it, length), "id long, begin long, stop long, gram long")
    settled = stashed(settled)
    removed = settled.where("stop >= 0").select("id", "begin", "stop")

    # anchors with several stretches: their windows, dealt by anchor and sorted
    opened = settled.where("stop < 0").select("id", F.col("begin").alias("packed"), "gram")
    often = opened.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > part).select("gram", F.ceil(F.col("n") / part).alias("parts"))
    opened = opened.join(often, "gram", "left").select("id", F.struct("gram", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), "parts")).otherwise(F.lit(-1)).cast("long").alias("part"), "packed").alias("x"))
    wanted = opened.groupBy("id").agg(F.collect_list("x").alias("xs"))
    windows = texts.join(wanted, "id").select("id", "text", "xs").mapInArrow(lambda it: _windows(it, length), "gram long, part long, id long, packed long, bytes binary")
    compared = windows.repartition("gram", "part").sortWithinPartitions("gram", "part", "id", "packed").mapInArrow(lambda it: _compared(it, length), "id long, begin long, stop long, window binary")
    removed = removed.union(compared.where("window is null").select("id", "begin", "stop"))
    split = compared.where("window is not null").withColumn("first", F.min(F.struct("id", "begin")).over(Window.partitionBy("window")))
    removed = removed.union(split.where("id <> first.id or begin <> first.begin").select("id", "begin", "stop"))

    marks = removed.select("id", F.struct("begin", "stop").alias("run"), F.lit(False).alias("whole"))
    marks = marks.union(firsts.select("id", F.lit(None).cast("struct<begin:long,stop:long>"), F.lit(True)))
    marks = marks.groupBy("id").agg(F.max("whole").alias("whole"), F.collect_list("run").alias("runs"))
    out = texts.join(marks, "id", "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")
    out = out.mapInArrow(lambda it: _kept(it, length), "id long, n_bytes long, removed array<struct<begin:long,stop:long>>, kept binary")
    return out.select(F.when(F.col("id") != least, F.col("id")).alias("doc_id"), "n_bytes", "removed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS x FROM (SELECT *, unnest(range(0, length(h) // 2)) AS p FROM d)),
w AS (SELECT r, p, left(x, 2) AS byte, length(x) = {2 * LENGTH} AND row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1 AS again FROM b),
c AS (SELECT r, p, byte, coalesce(max(CASE WHEN again THEN 1 END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM w),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), 0) = 0 AS head FROM c),
g AS (SELECT r, count(*) AS n, sum(gone) AS gone, count(*) FILTER (head) AS spans, string_agg(byte, '' ORDER BY p) FILTER (gone = 0) AS kept FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""
