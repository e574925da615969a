"""Runs of periodic words in texts, by minimizers at several scales.

A run with period q repeats each of its word grams at distance q, and of grams with at
least q words none sooner. So at a scale with grams of k words, periods from about k/1.4
to k show as equal neighbours among the chosen window minima; each such pair seeds an
extension word by word. Periods too short for windows are found by comparing the words
with themselves at each lag.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textbytes import chunks, mix

#: Periods up to this are found by direct lag scans.
LAGS = 16
#: The largest period of a scale over the largest of the scale before.
RATIO = 1.4
#: Rows are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 19
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i mod prime for i below n, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base % prime
    while done < n:
        part = out[: min(done, n - done)] * np.uint64(step) % np.uint64(prime)
        out[done : done + len(part)] = part
        done, step = done + len(part), step * step % prime
    return out


class Grams:
    """Hashes of all grams of a sequence of small numbers, for any length of gram, as
    polynomials over two primes."""

    def __init__(self) -> None:
        self.size, self.up, self.down = 0, (), ()

    def fit(self, x: np.ndarray) -> None:
        if self.size < len(x) + 1:
            self.size = max(len(x) + 1, 1 << 18)
            self.up = tuple(_powers(b, p, self.size) for b, p in zip(_BASES, _PRIMES))
            self.down = tuple(_powers(pow(b, -1, p), p, self.size) for b, p in zip(_BASES, _PRIMES))
        values = mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.sums = []
        for up, p, shift in zip(self.up, _PRIMES, (0, 32)):
            v = (values >> np.uint64(shift)) % np.uint64(p) * up[: len(x)] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]))

    def hashes(self, n: int, k: int) -> np.ndarray:
        """Of the grams of k within the first n."""
        m = n - k + 1
        a, b = ((s[k : k + m] - s[:m]) % np.uint64(p) * down[:m] % np.uint64(p) for s, down, p in zip(self.sums, self.down, _PRIMES))
        return mix((a << np.uint64(32)) | b)


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window of `width` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = op(out[:-have], out[have:]), have * 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of a window; equal least hashes all count."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == hashes)


def _differs(x: np.ndarray, at: int, lag: int, forward: bool) -> int:
    """The first place from `at` on (or the last before it) that differs from the place
    `lag` later; the end of the sequence (or -1) if none does."""
    step = 64
    while True:
        a, b = (at, min(at + step, len(x) - lag)) if forward else (max(at - step, 0), at)
        if a >= b:
            return b if forward else -1
        bad = np.flatnonzero(x[a:b] != x[a + lag : b + lag])
        if len(bad):
            return a + int(bad[0] if forward else bad[-1])
        at, step = (b if forward else a), min(step * 4, 1 << 20)


def runs_of(x: np.ndarray, longest: int, min_words: int = 24, min_repeats: int = 3, grams: Grams | None = None, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of a sequence of small numbers with at
    least `min_words` elements and `min_repeats` (three at least) periods; period is the least one.

    No run is longer than `longest`. With `ends`, the sequence is made of parts in order of falling
    length, with ends at these places, and parts too short for a scale are left out there.
    """
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, period: int) -> None:
        if end - start >= max(min_words, min_repeats * period):
            found[start, end] = min(period, found.get((start, end), period))

    for lag in range(1, min(LAGS, longest // min_repeats) + 1):
        same = np.flatnonzero(x[:-lag] == x[lag:])
        if len(same):
            cut = np.flatnonzero(np.diff(same) > 1)
            first, last = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]]
            for i in np.flatnonzero(last - first + 1 + lag >= max(min_words, min_repeats * lag)):
                add(int(first[i]), int(last[i]) + 1 + lag, lag)
    low, sizes = LAGS, None if ends is None else np.diff(ends, prepend=0)
    if longest >= min_repeats * (low + 1):
        grams = grams or Grams()
        grams.fit(x)
    while longest >= min_repeats * (low + 1):
        k = int(low * RATIO)
        n = len(x) if ends is None else int(ends[int((sizes >= min_repeats * (low + 1)).sum()) - 1])
        part = x[:n]
        h = grams.hashes(n, k) if n >= k else np.zeros(0, dtype=np.uint64)
        # a run of q > low has 2 q - k + 1 grams or more that come again at distance q
        at = minimizers(h, 2 * (low + 1) - k + 1)
        order = at[np.argsort(h[at], kind="stable")]
        gap = np.diff(order)
        seed = np.flatnonzero((gap > low) & (gap <= k) & (h[order[1:]] == h[order[:-1]])) if len(order) else []
        reached: dict[int, int] = {}
        for p, q in sorted(zip(order[seed].tolist(), gap[seed].tolist())) if len(seed) else ():
            if p >= reached.get(q, -1):
                end = _differs(part, p, q, True)
                reached[q] = end
                if end > p:
                    add(_differs(part, p, q, False) + 1, end + q, q)
        low = k
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at : max(at, a)]
        at = max(at, b)
    return out + words[at:]


def _block(texts: list[bytes], min_words: int, min_repeats: int, grams: Grams) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each of a few texts, which are searched as one sequence:
    between two of them stands a number of its own, which no run can cross."""
    words = [t.split() for t in texts]
    order = sorted((i for i, w in enumerate(words) if len(w) >= max(min_words, min_repeats)), key=lambda i: -len(words[i]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if order:
        parts, fresh = [], count()
        for i in order:
            names = defaultdict(fresh.__next__)  # numbers the words of each text anew
            parts += [np.fromiter(map(names.__getitem__, words[i]), dtype=np.int64, count=len(words[i])), np.array([next(fresh)])]
        ends = np.cumsum([len(words[i]) + 1 for i in order])
        for start, length, period in runs_of(np.concatenate(parts), len(words[order[0]]), min_words, min_repeats, grams, ends):
            j = int(np.searchsorted(ends, start, side="right"))
            runs[order[j]].append((start - (int(ends[j - 1]) if j else 0), length, period))
    return [(r, b" ".join(collapse(w, r) if r else w)) for r, w in zip(runs, words)]


def find_runs(docs: DataFrame, text_col: str = "text", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """Adds to docs, in place of columns of these names, `runs`: an array of (start, length,
    period) by start, then period, of all maximal stretches of words ([^\\x20\\x09-\\x0D]+,
    numbered from 0) with that least period, at least `min_words` words and `min_repeats`
    periods (three at least); and `collapsed`: the words, joined by one space, without those
    that some run contains after its first period.

    Defined cases: null and empty texts have no run and an empty collapsed text; each row
    is searched whole and by itself, so repeated rows agree; overlapping runs are all
    reported; extra columns of any name pass through; an empty table stays empty. No row
    leaves its task, so no key can be hot; a task holds one block of texts, or one long text.
    """
    if min_repeats < 3:
        raise ValueError("runs of fewer than three periods are not found by this method")
    docs = docs.drop("runs", "collapsed")
    columns, at = docs.columns, docs.columns.index(text_col)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    listed = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at), BLOCK):
                done = _block([data[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])], min_words, min_repeats, grams)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs, _ in done], listed)
                texts = pa.array([t for _, t in done], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), runs, texts], names=[*columns, "runs", "collapsed"])

    return docs.mapInArrow(search, schema)
