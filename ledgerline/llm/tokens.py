"""Words and hashes of whole Arrow string columns with numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerline.operators.batches import groups  # noqa: F401  operators use it with the rest

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random number for each byte, from a rule.
_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0x9FB21C651E98DF25)


def _powers(n: int, cache=[np.ones(1, U)]) -> np.ndarray:  # noqa: B006
    if len(cache[0]) < n:
        full = np.full(max(n, 256), _BASE, U)
        full[0] = 1
        cache[0] = np.cumprod(full, dtype=U)
    return cache[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and offsets of its rows, one more than rows."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that cross no row offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of bytes other than ASCII white space."""
    starts, ends = runs(~_SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int | None = None, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of data[start:end], or of the first ``limit`` bytes of each."""
    out = np.empty(len(starts), U)
    for a in range(0, len(starts), block):
        s = starts[a : a + block]
        n = ends[a : a + block] - s
        if limit is not None:
            n = np.minimum(n, limit)
        first = np.cumsum(n) - n
        total = int(n.sum())
        at = np.arange(total) - np.repeat(first, n)
        h = _BYTE[data[at + np.repeat(s, n)]]
        h *= _powers(int(n.max()))[at]
        out[a : a + block] = np.add.reduceat(h, first)
    return mix64(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z made lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def window_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` hashes, whatever rows they cross."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(size):
        h *= _BASE
        h += word[j : j + n]
    return mix64(h)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text, small ones joined; a longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + max_bytes - size, "right")) - 1
            if last <= first and not held:
                last = first + 1
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(at[last] - at[first])
                first = last
            if first < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()
