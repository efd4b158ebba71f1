"""Byte-level BPE, encoded by speculation: greedy longest matches, verified pair by pair, merged exactly only where that fails.

A sequence of tokens is the encoding of its word if and only if each token
encodes itself and each two neighbours encode, joined, as just these two:
a merge across a boundary would have to happen in such a pair as well. So a
guess can be verified with a table of pairs, and the guess is right for most
words. All steps run over whole columns: word boundaries come from a table of
character classes, equal words are handled once, the guesses of all new words
walk a trie together, and the pairs of all guesses are looked up at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import vectext as vt

VOCABULARY = "byte_bpe_50k.json"
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Words up to this many bytes walk the trie together; longer ones are merged exactly at once.
LONG = 64
#: Words, and pairs, that a worker remembers; beyond that it starts anew.
MOST_WORDS = 100_000
#: Bytes of text that are encoded together.
BATCH = 1 << 20
_CODECS: dict[str | None, Codec] = {}


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[[ord(c) for c in m[0]]] = kind
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def distinct(data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal bytes only, and the first word of each number.

    Hashes part the words; equal ones are then compared byte by byte, and
    words go by their bytes should a hash ever stand for two.
    """
    codes, every = pd.factorize(vt.span_hashes(data, starts, ends))
    first = np.full(len(every), -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if not vt.same_spans(data, starts, ends, first[codes]).all():
        words = np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object)
        codes, every = pd.factorize(words)
        first = np.full(len(every), -1, np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


class Codec:
    """Encodes and decodes columns of texts with one vocabulary."""

    def __init__(self, path: str | None = None, special: bool = True) -> None:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])} if special else {}
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = raw(s)
        for t in spec.get("added_tokens", []):
            self.bytes_of[t["id"]] = t["content"].encode()
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.decimal = np.array([str(i) for i in range(size)], object)
        self.payload = np.array(self.bytes_of, object)
        self._trie({self.bytes_of[i]: i for i in vocab.values()})
        self.classes = _classes()
        self.pairs: dict[int, bool] = {}
        self._forget()

    # -- vocabulary -------------------------------------------------------
    def _trie(self, tokens: dict[bytes, int]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        for t in tokens:
            for k in range(1, len(t) + 1):
                nodes.setdefault(t[:k], len(nodes))
        keys = np.fromiter((nodes[p[:-1]] * 256 + p[-1] for p in nodes if p), np.int64, len(nodes) - 1)
        ends = np.fromiter((n for p, n in nodes.items() if p), np.int64, len(nodes) - 1)
        order = np.argsort(keys)
        self.edge_keys, self.edge_ends = keys[order], ends[order]
        self.accepts = np.full(len(nodes), -1, np.int64)
        for t, i in tokens.items():
            self.accepts[nodes[t]] = i

    def _forget(self) -> None:
        self.known: dict[bytes, np.ndarray] = {}

    # -- words ------------------------------------------------------------
    def word_starts(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where words start, in bytes; no word goes across a cut (sorted offsets, 0 and the length included).

        Words: the contractions 's 't 're 've 'm 'll 'd, runs of letters, of
        numbers or of other signs, each with one space before, and runs of
        white space, which leave their last character to what follows.
        """
        if not len(data):
            return np.zeros(0, np.int64)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[code]
        n = len(code)
        fresh = np.zeros(n + 1, bool)
        fresh[np.searchsorted(at, cuts[cuts < len(data)])] = True
        fresh[n] = True
        run = fresh.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        starts = run[:n].copy()
        # white space before something: the last character parts from the rest, and a blank joins what follows
        heads = np.flatnonzero(run[:n] & ~fresh[:n])
        heads = heads[kind[heads - 1] == SPACE]
        starts[heads - 1] = True
        starts[heads[code[heads - 1] == 32]] = False
        # contractions
        quote = np.flatnonzero((code == 39) & starts)
        quote = quote[quote + 1 < n]
        quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
        if len(quote):
            one = code[quote + 1]
            two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            short = np.isin(one, [ord(c) for c in "stmd"])
            quote, long = quote[long | short], long[long | short]
            starts[quote + 1] = False
            after = quote + 2 + long
            starts[after[after < n]] = True
        return at[starts]

    def exact(self, word: bytes) -> list[int]:
        """The merges in order of rank, the leftmost first among equals."""
        ids = [self.byte_ids[b] for b in word]
        merges = self.merges
        if len(ids) <= LONG:
            while len(ids) > 1:
                best, where, made = 1 << 60, -1, -1
                for i in range(len(ids) - 1):
                    m = merges.get((ids[i], ids[i + 1]))
                    if m is not None and m[0] < best:
                        best, where, made = m[0], i, m[1]
                if where < 0:
                    break
                ids[where : where + 2] = [made]
            return ids
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := merges.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def guesses(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words together: tokens, and bounds of each word's."""
        where, who, tokens, order = starts.copy(), np.arange(len(starts)), [], []
        turn = 0
        while len(who):
            node, pos = np.zeros(len(who), np.int64), where.copy()
            token, reach = np.full(len(who), -1, np.int64), where.copy()
            live = np.arange(len(who))
            while len(live):
                key = node[live] * 256 + data[pos[live]]
                found = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                live, found = live[ok := self.edge_keys[found] == key], found[ok]
                node[live] = self.edge_ends[found]
                pos[live] += 1
                got = live[self.accepts[node[live]] >= 0]
                token[got], reach[got] = self.accepts[node[got]], pos[got]
                live = live[pos[live] < ends[who[live]]]
            tokens.append(token)
            order.append(who * 256 + turn)
            turn += 1
            more = reach < ends[who]
            where, who = reach[more], who[more]
        order, tokens = np.concatenate(order), np.concatenate(tokens)
        by = np.argsort(order)
        return tokens[by], np.searchsorted(order[by] // 256, np.arange(len(starts) + 1))

    def verified(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which words have only pairs that stay apart, and only tokens that encode themselves."""
        ok = np.ones(len(bounds) - 1, bool)
        own = np.repeat(np.arange(len(ok)), np.diff(bounds))
        same = own[1:] == own[:-1]
        keys = np.concatenate([tokens[:-1][same] << 20 | tokens[1:][same] + 1, tokens << 20])
        owner = np.concatenate([own[:-1][same], own])
        codes, every = pd.factorize(keys)
        good = np.empty(len(every), bool)
        for i, key in enumerate(every.tolist()):
            v = self.pairs.get(key)
            if v is None:
                a, b = key >> 20, (key & 0xFFFFF) - 1
                v = self.exact(self.bytes_of[a]) == [a] if b < 0 else self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
                self.pairs[key] = v
            good[i] = v
        ok[owner[~good[codes]]] = False
        return ok

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray | None] = [None] * len(starts)
        short = np.flatnonzero(ends - starts <= LONG)
        if len(short):
            tokens, bounds = self.guesses(data, starts[short], ends[short])
            ok = self.verified(tokens, bounds)
            tokens = tokens.astype(np.int32)
            for k in np.flatnonzero(ok).tolist():
                out[short[k]] = tokens[bounds[k] : bounds[k + 1]].copy()
        return [np.array(self.exact(data[starts[k] : ends[k]].tobytes()), np.int32) if x is None else x for k, x in enumerate(out)]

    # -- columns ----------------------------------------------------------
    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text's."""
        data, offsets = vt.buffers(column)
        cuts, marks = offsets, {}
        if self.special:
            whole = data.tobytes()
            for s, i in self.special.items():
                p = whole.find(s)
                while p >= 0:
                    if np.searchsorted(offsets, p, "right") == np.searchsorted(offsets, p + len(s), "left"):
                        marks[p] = (p + len(s), i)
                    p = whole.find(s, p + len(s))
            if marks:
                cuts = np.unique(np.concatenate([offsets, [x for p, (e, _) in marks.items() for x in (p, e)]]))
        starts = self.word_starts(data, cuts)
        if marks:  # a special token is one word
            inside = np.zeros(len(starts), bool)
            for p, (e, _) in marks.items():
                inside[np.searchsorted(starts, p + 1) : np.searchsorted(starts, e)] = True
            starts = starts[~inside]
        ends = np.append(starts[1:], len(data))
        raw = data.tobytes()
        codes, first = distinct(data, raw, starts, ends)
        if len(self.known) > MOST_WORDS:
            self._forget()
        if len(self.pairs) > 4 * MOST_WORDS:
            self.pairs.clear()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        parts = [self.known.get(k) for k in keys]
        new = np.array([i for i, x in enumerate(parts) if x is None], np.int64)
        if len(new):
            for i, x in zip(new.tolist(), self._learn(data, starts[first[new]], ends[first[new]]), strict=True):
                parts[i] = x
                if len(keys[i]) <= LONG:
                    self.known[keys[i]] = x
        for p, (_, i) in marks.items():
            w = int(np.searchsorted(starts, p))
            parts[codes[w]] = np.array([i], np.int32)
        size = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        base = np.cumsum(size) - size
        lengths = size[codes]
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        ids = flat[np.repeat(base[codes] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are no text become U+FFFD."""
        raw = b"".join(self.payload[ids].tolist())
        return raw.decode("utf-8", "replace").encode()


def codec(path: str | None = None, special: bool = True) -> Codec:
    """One codec per worker process and vocabulary."""
    key = f"{path}|{special}"
    if key not in _CODECS:
        _CODECS[key] = Codec(path, special)
    return _CODECS[key]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has no ids, ids of any type and repeated rows stay as they are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vt.pieces(batches, BATCH):
            ids, bounds = codec(vocabulary).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(docs: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of ids; null gives null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else codec(vocabulary).decode(np.array(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, as digests.

    Null and empty texts have no tokens; the digests are then of nothing.
    Repeated rows come as often as they stand; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vt.pieces(batches, BATCH):
            own = codec(vocabulary)
            ids, bounds = own.encode(batch.column(1))
            sha, back = [], []
            for i in range(batch.num_rows):
                part = ids[bounds[i] : bounds[i + 1]]
                sha.append(hashlib.sha256(",".join(own.decimal[part].tolist()).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(part)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
