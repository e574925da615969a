"""Vectorised tokenising and hashing of Arrow string columns with numpy.

Texts are handled as one run of UTF-8 bytes per chunk, so no Python object is
made per word. White space is [\\x20\\x09-\\x0D] throughout; as these bytes never
occur inside a multi-byte character, working on bytes equals working on text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
BYTE_VALUES = _splitmix(256, 12345)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up, self.down = powers(_P, size), powers(_PINV, size)
        return self.up, self.down


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole rows of about `most` bytes.

    Yields (first row, end row, bytes, row offsets into them). Null is empty. A
    text longer than `most` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a chunk, and the row of each word.

    A row's end ends a word as white space does. `word` may mark the bytes that
    belong to words instead.
    """
    if word is None:
        word = ~IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    start[edges] |= word[edges]
    end = word.copy()
    end[:-1] &= ~word[1:]
    before = edges[edges > 0] - 1
    end[before] |= word[before]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, pw: Powers) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of 64-bit values."""
    up, down = pw.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, pw: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a chunk, in order."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(BYTE_VALUES[LOWER[data] if lower else data], starts, ends, pw), rows


_GRAM = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)]


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words within a row; rows with 1 to n-1 words
    have their whole sequence as one."""
    if not len(hashes):
        return hashes, rows
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * np.uint64(_GRAM[k])
    same = rows[: len(out)] == rows[n - 1 : n - 1 + len(out)]
    full, full_rows = mix(out[same]), rows[: len(out)][same]
    counts = np.bincount(rows)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return full, full_rows
    first = np.searchsorted(rows, short)
    extra = np.array([sum(int(h) * _GRAM[k] for k, h in enumerate(hashes[f : f + counts[r]])) & _MASK for f, r in zip(first, short)], dtype=np.uint64)
    extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    all_rows = np.concatenate([full_rows, short])
    order = np.argsort(all_rows, kind="stable")
    return np.concatenate([full, extra])[order], all_rows[order]
