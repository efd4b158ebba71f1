"""Vectorised work on the UTF-8 bytes of a whole Arrow string column.

A column of texts is handled as one byte buffer with offsets, so the cost of
a batch is a few numpy passes over its bytes, however long single texts are.
Words are runs of bytes of a given class; classes only tell ASCII bytes apart,
so a run of bytes is also a run of code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Spans over so many bytes are hashed one by one.
LONG_SPAN = 1024
#: The lowest 0 to 8 bytes of a number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def byte_class(excluded: str) -> np.ndarray:
    """A table of 256 flags: True for bytes that belong to words.

    excluded lists the ASCII characters that separate words.
    """
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(excluded.encode("ascii"), dtype=np.uint8)] = False
    return table


#: `[^\x20\x09-\x0D]+`
NON_SPACE = byte_class(" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: ASCII letters and digits, and all beyond ASCII.
ALNUM = byte_class("".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column and the offsets of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word (one more entry than texts)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    stops = inside[:-1] & ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, little-endian, the end of the data included; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand.

    Eight bytes at a time are mixed into all spans together, each time by a
    bijection, so that no family of texts is known to share hashes. Spans over
    LONG_SPAN go through BLAKE2.
    """
    size = ends - starts
    out = mixed(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D))
    at = eights(data)
    live, k = np.flatnonzero(size <= LONG_SPAN), 0
    while len(live):
        rest = size[live] - k
        x = at[starts[live] + k] & _LOW_BYTES[np.minimum(rest, 8)]
        out[live] = mixed(out[live] ^ x) + _U(0x9E3779B97F4A7C15)
        live, k = live[rest > 8], k + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span of index other."""
    size = ends - starts
    out = size == size[other]
    at = eights(data)
    live, k = np.flatnonzero(out & (size <= LONG_SPAN) & (other != np.arange(len(size)))), 0
    while len(live):
        rest, two = size[live] - k, other[live]
        bad = ((at[starts[live] + k] ^ at[starts[two] + k]) & _LOW_BYTES[np.minimum(rest, 8)]) != 0
        out[live[bad]] = False
        live, k = live[~bad & (rest > 8)], k + 8
    for i in np.flatnonzero(out & (size > LONG_SPAN)).tolist():
        j = other[i]
        out[i] = bool((data[starts[i] : ends[i]] == data[starts[j] : ends[j]]).all())
    return out


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width consecutive words of one text, and the index of each window's first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0xA0761D6478BD642F | 1)
    for k in range(width):
        total = total * factor + h[k : k + n]
    inside = np.ones(n, dtype=bool)
    for k in range(1, width):  # a window starting within width-1 words of a text's end leaves it
        at = first[1:-1] - k
        inside[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(inside)
    return mixed(total[at]), at


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from words()'s third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pieces(batches: Iterator[pa.RecordBatch], most: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    released()


def released() -> None:
    """Gives memory that nothing uses back to the system, as workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
