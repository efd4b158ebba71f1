"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Training words stream
through it, and at each word it gives the length of the longest run, ending
there, that some item holds. Where that length reaches the window, the words
of the run are hit. Streaming starts only where `seed` words in a row stand in
some item, which a vectorised look-up of hashes finds: elsewhere no match can
reach the window.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import vectext as vt
from llm.shared import named, stashed

WINDOW = 10
SEED = 4
#: Characters of items that one automaton takes, of 12 bytes each at most; more items are scanned in blocks of this size.
BLOCK_CHARS = 20_000_000


class _Builder:
    """The automaton while it grows: a state's first transition in arrays, further ones of the few that branch in dicts."""

    def __init__(self) -> None:
        self.word, self.to = array("Q", [0]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def step(self, v: int, w: int) -> int:
        """The state behind v by the word w, or -1."""
        if self.to[v] >= 0 and self.word[v] == w:
            return self.to[v]
        return self.more[v].get(w, -1) if v in self.more else -1

    def _put(self, v: int, w: int, to: int) -> None:
        if self.to[v] < 0 or self.word[v] == w:
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self.step(p, w) < 0:
            self._put(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, link: int) -> int:
        self.word.append(0)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q])
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self.step(p, w) == q:
            self._put(p, w, copy)
            p = self.link[p]
        return copy


def _as_array(kind: str, values: np.ndarray) -> array:
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values).tobytes())
    return out


class ItemAutomaton:
    """All runs of words of the items, in arrays; words are 64-bit hashes.

    Transitions stand sorted by state and word, and the items of a window or
    of a whole shorter item by state: some 60 bytes for a word of the items.
    """

    def __init__(self, ids: list[str | None], items: list[np.ndarray], window: int) -> None:
        self.window, self.ids = window, ids
        grown = _Builder()
        for words in items:
            last = 0
            for w in words.tolist():
                last = grown.extend(last, w)
        n = len(grown.length)
        link, length = np.array(grown.link, np.int32), np.array(grown.length, np.int32)
        # the state on the suffix path that holds the run of `window` words
        at = np.where(length < window, -1, np.arange(n, dtype=np.int32)).astype(np.int32)
        holds = np.where(length[np.maximum(link, 0)] < window, at, -2).astype(np.int32)
        up = link.copy()
        while (open_ := np.flatnonzero((holds == -2) & (at >= 0))).size:  # paths halve each time
            holds[open_] = holds[up[open_]]
            up[open_] = up[up[open_]]
        self.window_state = _as_array("i", np.where(at < 0, -1, holds))
        self.link, self.length = grown.link, grown.length

        def holding(v: int, size: int) -> int:
            while self.length[self.link[v]] >= size:
                v = self.link[v]
            return v

        whole: list[tuple[int, int, int]] = []
        found: list[np.ndarray] = []
        for item, words in enumerate(items):
            v, states = 0, array("i")
            for w in words.tolist():
                v = grown.step(v, w)
                states.append(v)
            if len(words) >= window:
                # the run of `window` words that ends here is held by the state's window state
                x = np.array([self.window_state[v] for v in states[window - 1 :]], np.int64)
                found.append(np.unique(x) << 32 | item)
            elif len(words):
                whole.append((holding(v, len(words)), len(words), item))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.item_states, self.item_of = _as_array("i", (pairs >> 32).astype(np.int32)), _as_array("i", (pairs & 0xFFFFFFFF).astype(np.int32))
        self.whole: dict[int, dict[int, set[int]]] = {}
        for v, size, item in whole:
            self.whole.setdefault(v, {}).setdefault(size, set()).add(item)
        # the nearest state on the suffix path that ends a whole shorter item
        self.short_state = array("i")
        if self.whole:
            short = array("i", [-1]) * n
            for v in np.argsort(length[1:], kind="stable").tolist():
                v += 1
                short[v] = v if v in self.whole else short[self.link[v]]
            self.short_state = short
        # transitions by state, then word
        first = np.flatnonzero(np.array(grown.to, np.int32) >= 0).astype(np.int32)
        extra = [(v, w, t) for v, more in grown.more.items() for w, t in more.items()]
        state = np.concatenate([first, np.array([x[0] for x in extra], np.int32)])
        word = np.concatenate([np.array(grown.word, np.uint64)[first], np.array([x[1] for x in extra], np.uint64)])
        to = np.concatenate([np.array(grown.to, np.int32)[first], np.array([x[2] for x in extra], np.int32)])
        order = np.lexsort((word, state))
        self.words, self.to = _as_array("Q", word[order]), _as_array("i", to[order])
        self.edges = _as_array("i", np.searchsorted(state[order], np.arange(n + 1)).astype(np.int32))
        sizes = [len(w) for w in items if len(w)]
        self.least = min([window, *sizes])
        self.seed = min(SEED, self.least)
        flat = np.concatenate([*items, np.zeros(0, np.uint64)]).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        self.seeds = np.unique(vt.window_hashes(flat, bounds, self.seed)[0])
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def step(self, v: int, w: int) -> int:
        low, high = self.edges[v], self.edges[v + 1]
        at = bisect_left(self.words, w, low, high)
        return self.to[at] if at < high and self.words[at] == w else -1

    def _items(self, state: int) -> set[int]:
        low = bisect_left(self.item_states, state)
        high = bisect_right(self.item_states, state, low)
        return set(self.item_of[low:high])

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (start, end), merged, and the items, by place, whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = size = 0
        for i, w in enumerate(words):
            to = self.step(v, w)
            while v and to < 0:
                v = self.link[v]
                size = self.length[v]
                to = self.step(v, w)
            v, size = (to, size + 1) if to >= 0 else (0, 0)
            reach = 0
            if size >= self.window:
                reach = size
                found |= self._items(self.window_state[v])
            u = self.short_state[v] if self.whole else -1
            while u >= 0:
                for k, items in self.whole[u].items():
                    if k <= size:
                        reach = max(reach, k)
                        found |= items
                u = self.short_state[self.link[u]] if self.link[u] >= 0 else -1
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found

    def scan(self, h: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Hits by text, for texts that have any; spans count the words of all texts."""
        w, at = vt.window_hashes(h, first, self.seed)
        near = np.flatnonzero(self.coarse[(w >> np.uint64(44)).astype(np.int64)])
        if not len(self.seeds) or not len(near):
            return {}
        place = np.minimum(np.searchsorted(self.seeds, w[near]), len(self.seeds) - 1)
        at = at[near[self.seeds[place] == w[near]]]
        if not len(at):
            return {}
        text = np.searchsorted(first, at, "right") - 1
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(text) > 0)) + 1
        begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            if e - b + self.seed - 1 < self.least:
                continue
            low = int(at[b])
            spans, found = self.stream(h[low : int(at[e - 1]) + self.seed].tolist())
            if spans:
                have = out.setdefault(int(text[b]), ([], set()))
                have[0].extend((low + s, low + t) for s, t in spans)
                have[1].update(found)
        return out


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = vt.buffers(column)
    data = vt.lowered(data)
    starts, ends, first = vt.words(data, offsets, vt.ALNUM)
    return starts, ends, first, vt.span_hashes(data, starts, ends)


def automaton(ids: list[str | None], texts: list[str], window: int) -> ItemAutomaton:
    _, _, first, h = _hashed(pa.array(texts, pa.string()))
    return ItemAutomaton(ids, [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = "array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, hit_spans (words, end exclusive, merged) and hit_items (sorted as strings) added.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with
    A-Z lower-cased. A window is `window` consecutive words of an item, or a
    shorter item as a whole. Items without words have no windows; those of an
    item with a null id are hit, but it is not listed; items of one id are
    listed once. A null text has no words. Repeated rows of docs stay. docs may
    have no columns named like the added ones, which raises an error. With no
    items nothing is hit. The automaton is built once and broadcast, for at
    most block_chars characters of items; docs are scanned again for each
    further block.
    """
    if clash := {c.lower() for c in docs.columns} & {"n_words", "hit_spans", "hit_items"}:
        raise ValueError(f"docs has columns of the names that are added: {', '.join(sorted(clash))}")
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = _contaminated(docs.toDF(*names), items, names[docs.columns.index(text_col)], item_id, item_text, window, block_chars, None)
    return out.toDF(*docs.columns, "n_words", "hit_spans", "hit_items")


def _contaminated(rows: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block_chars: int, coverage: float | None) -> DataFrame:
    """contamination(), or, for a coverage, decontaminated(), in one pass over rows for each block of items."""
    spark = rows.sparkSession
    items = items.select(named(item_id).cast("string").alias("id"), named(item_text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        table = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()
        if b:
            rows = stashed(rows)
        rows = _scanned(rows, spark.sparkContext.broadcast(automaton(table["id"].to_pylist(), table["text"].to_pylist(), window)), text_col, b > 0, coverage if b == blocks - 1 else None)
    return rows


def _cut(columns: dict[str, pa.Array], text_col: str, spans: list[list[tuple[int, int]]], n_words: np.ndarray, coverage: float) -> pa.RecordBatch:
    """Rows without their spans, and without rows of which spans cover more than the coverage."""
    hit = np.array([sum(e - s for s, e in x) for x in spans], np.int64)
    if hit.any():
        texts = columns[text_col].to_pylist()
        counts = columns["n_chars"].to_pylist() if "n_chars" in columns else None
        for i in np.flatnonzero(hit).tolist():
            raw = np.frombuffer(texts[i].encode(), np.uint8)
            starts, ends, _ = vt.words(vt.lowered(raw), np.array([0, len(raw)]), vt.ALNUM)
            keep, last = [], 0
            for s, e in spans[i]:
                keep.append(raw[last : starts[s]].tobytes())
                last = ends[e - 1]
            texts[i] = b"".join([*keep, raw[last:].tobytes()]).decode()
            if counts:
                counts[i] = len(texts[i])
        columns[text_col] = pa.array(texts, columns[text_col].type)
        if counts:
            columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
    out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return out.filter(pa.array(hit <= coverage * np.maximum(n_words, 1)))


def _scanned(rows: DataFrame, block, text_col: str, more: bool, coverage: float | None) -> DataFrame:
    added = ("n_words", "hit_spans", "hit_items")
    fields = [f for f in rows.schema.fields if coverage is None or not more or f.name not in added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    if not more and coverage is None:
        schema += f", n_words bigint, hit_spans {SPANS}, hit_items array<string>"
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for batch in vt.pieces(batches, text=text_col):
            starts, _, first, h = _hashed(batch.column(at))
            hits = own.scan(h, first)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            spans: list = [[] for _ in range(batch.num_rows)]
            found: list = [[] for _ in range(batch.num_rows)]
            if more:
                spans = [[(x["start"], x["end"]) for x in y] for y in columns["hit_spans"].to_pylist()]
                found = columns["hit_items"].to_pylist()
            for t, (s, f) in hits.items():
                base = int(first[t])
                spans[t] = _merged([*spans[t], *((a - base, b - base) for a, b in s)])
                found[t] = sorted({*found[t], *(own.ids[x] for x in f if own.ids[x] is not None)})
            if coverage is not None:
                yield _cut({c: v for c, v in columns.items() if not more or c not in added}, text_col, spans, np.diff(first), coverage)
                continue
            columns["n_words"] = pa.array(np.diff(first), pa.int64())
            columns["hit_spans"] = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns["hit_items"] = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without their hit spans, each as long as a window at least, and without the documents of which spans cover more than `coverage` of the words.

    The columns are those of docs; n_chars, where docs has it, follows the
    text. Rows that lose nothing stay as they are, null texts too.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of docs can clash with an added one; n_chars keeps its own
    names = ["n_chars" if c == "n_chars" else n for c, n in zip(docs.columns, names, strict=True)]
    plain = docs.toDF(*names)
    out = _contaminated(plain, items, names[docs.columns.index(text_col)], item_id, item_text, window, block_chars, coverage)
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS x FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT r, s, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.x = iw.x),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM h)) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""
