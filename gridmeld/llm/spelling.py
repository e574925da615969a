"""Spelling variants: words within one edit of a more frequent one.

The vocabulary is sorted, once from its beginnings and once from its ends, and dealt to
pieces of the order. A word of length l whose half is untouched by the edit shares that
half with its near words, so it is sent to the pieces that the half's interval of the
order meets and whose shared beginning can still be within one edit. There the interval is scanned in
order: rows of the banded edit matrix are kept as far as the next word shares its
beginning with the last, and words whose shared beginning is already beyond one edit
are skipped together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Words of a piece, and the most pieces; queries of one task.
PIECE, MOST_PIECES, QUERIES = 20_000, 4096, 50_000
#: Follows every string that begins with what stands before it.
_TOP = "\U0010ffff\U0010ffff"
_FAR = 2


def _step(row: tuple[int, int, int], same: tuple[bool, bool, bool]) -> tuple[int, int, int]:
    """The next row of the edit matrix's band from the last, of which cells j - 1, j and
    j + 1 are given: cells j, j + 1 and j + 2, where `same` tells whether the new letter is
    the target's before each of the new cells. Beyond one edit all is the same."""
    left, mid, right = row
    a = min(left + (not same[0]), mid + 1)
    b = min(mid + (not same[1]), right + 1, a + 1)
    c = min(right + (not same[2]), b + 1)
    return min(a, _FAR), min(b, _FAR), min(c, _FAR)


def _rows() -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """All rows that can follow (0 comes first) and for each what the 8 possible `same` lead to; a dead row is -1."""
    rows, following = [(_FAR, 0, 1)], []
    for row in rows:
        out = []
        for bits in range(8):
            new = _step(row, (bool(bits & 1), bool(bits & 2), bool(bits & 4)))
            if min(new) < _FAR and new not in rows:
                rows.append(new)
            out.append(rows.index(new) if min(new) < _FAR else -1)
        following.append(out)
    return following, rows


_NEXT, _ROWS = _rows()


def _letters(target: str) -> list[str | None]:
    """The target with places around it that no letter equals."""
    return [None, *target, None, None, None, None]


def prefix_within(prefix: str, target: str) -> bool:
    """Whether some word that begins with `prefix` can be within one edit of `target`."""
    row, t = 0, _letters(target)
    for j, c in enumerate(prefix):
        row = _NEXT[row][(c == t[j]) + 2 * (c == t[j + 1]) + 4 * (c == t[j + 2])]
        if row < 0:
            return False
    return True


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Sorted:
    """A sorted list of words, what each shares with the one before, and the next place
    that shares less."""

    def __init__(self, words: list[str]) -> None:
        self.words, n = words, len(words)
        self.shared = [0, *(_shared(a, b) for a, b in zip(words, words[1:])), -1][: n + 1] if n else [-1]
        self.less = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = i + 1
            while self.shared[j] >= self.shared[i]:
                j = self.less[j]
            self.less[i] = j

    def near(self, query: str, anchor: int) -> Iterator[int]:
        """Places of words that begin with the query's first `anchor` letters and are exactly one edit from it."""
        words, shared, less, following = self.words, self.shared, self.less, _NEXT
        begin, m = query[:anchor], len(query) - anchor
        i, end = bisect_left(words, begin), bisect_left(words, begin + _TOP)
        t = _letters(query[anchor:])
        rows, depth = [0] * (m + 4), 0
        while i < end:
            # the rows of the letters that the last word shares stay
            word, j = words[i], depth
            row, size = rows[j], len(word) - anchor
            while j < size:
                c = word[anchor + j]
                row = following[row][(c == t[j]) + 2 * (c == t[j + 1]) + 4 * (c == t[j + 2])]
                j += 1
                if row < 0:
                    break
                rows[j] = row
            if row < 0:
                # no word with this beginning can be near: go on behind all of them
                beyond, i = anchor + j, i + 1
                while shared[i] >= beyond:
                    i = less[i]
            else:
                if -1 <= m - size <= 1 and _ROWS[row][m - size + 1] == 1:
                    yield i
                i += 1
            depth = shared[i] - anchor


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"[A-Za-zÀ-ÿ]+") -> DataFrame:
    """(id, token): the pattern's matches in each whole text, A to Z lower-cased; null texts have none."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
    return docs.select(F.col(id_col).alias("id"), found.alias("token")).select("id", ascii_lower(F.col("token")).alias("token"))


def vocabulary(words: DataFrame, word_col: str = "token", min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least `min_chars` code points and their occurrences, of which there are `min_count` at least."""
    long = words.where(F.char_length(word_col) >= min_chars)
    return long.groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _pieces(bounds: list[tuple[int, str, str]], df: DataFrame) -> DataFrame:
    """(piece, s, anchor) for each query (s, anchor) and piece that may hold near words of it."""
    ids, lows, highs = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]
    heads = [a[: _shared(a, b)] for a, b in zip(lows, highs)]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, anchor in zip(batch["s"], batch["anchor"]):
                begin = s[:anchor]
                first, last = bisect_left(highs, begin), bisect_right(lows, begin + _TOP)
                out += [(ids[p], s, anchor) for p in range(first, last) if last - first == 1 or prefix_within(heads[p][anchor:], s[anchor:])]
            yield pd.DataFrame(out, columns=["piece", "s", "anchor"])

    return df.mapInPandas(route, "piece int, s string, anchor int")


def _near(vocab: DataFrame, n_words: int, back: bool) -> DataFrame:
    """(word, near, near_n) of pairs whose first half agrees, or with `back` those whose
    second half agrees and first doesn't."""
    turned = F.reverse("word") if back else F.col("word")
    half = F.floor(F.char_length("word") / 2)
    pieces = max(1, min(MOST_PIECES, -(-n_words // PIECE)))
    ordered = vocab.select(turned.alias("s"), "n").repartitionByRange(pieces, "s").withColumn("piece", F.spark_partition_id())
    ordered = written(ordered, "ordered_words")
    # one row per piece
    bounds = sorted((r["piece"], r["low"], r["high"]) for r in ordered.groupBy("piece").agg(F.min("s").alias("low"), F.max("s").alias("high")).collect())
    queries = written(_pieces(bounds, vocab.select(turned.alias("s"), (F.char_length("word") - half if back else half).cast("int").alias("anchor"))), "word_queries")
    # a piece asked by very many is given to several tasks
    parts = queries.groupBy("piece").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # one row per piece
    members = ordered.join(parts, "piece").select("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "s", "n", F.lit(-1).alias("anchor"))
    asked = queries.join(parts, "piece").select("piece", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"), "s", F.lit(0).cast("long").alias("n"), "anchor")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["anchor"] < 0].sort_values("s")
        words, counts = own["s"].tolist(), own["n"].tolist()
        ordered, out = Sorted(words), []
        for s, anchor in rows.loc[rows["anchor"] >= 0, ["s", "anchor"]].itertuples(index=False):
            for i in ordered.near(s, anchor):
                if not back:
                    out.append((s, words[i], counts[i]))
                elif not words[i].endswith(s[anchor:]):  # those that share the first half too are found from the front
                    out.append((s[::-1], words[i][::-1], counts[i]))
        return pd.DataFrame(out, columns=["word", "near", "near_n"])

    return members.unionByName(asked).groupBy("piece", "part").applyInPandas(search, "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form), where each form is more frequent than its word, so
    that no chain has a ring: pointers are doubled until none moves."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").head(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(vocab: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) with distinct words.

    Words are near if exactly one code point inserted, deleted or replaced makes one the other. form is the near
    word of largest n (ties: smallest in code point order) if that n is at least `factor` (two at least)
    times the word's, and null otherwise; root is where the forms lead in the end.

    Defined cases: a null or empty word, which no vocabulary() has, has no near words; an empty
    vocabulary gives an empty table; no near word is lost, however many share a half, as
    a piece holds a bounded share of the sorted list and its queries are dealt to tasks.
    """
    if factor < 2:
        raise ValueError("forms must be at least twice as frequent as their words")
    vocab = written(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    n_words = vocab.count()
    usable = vocab.where("word is not null and word != ''")
    pairs = written(_near(usable, n_words, False).unionByName(_near(usable, n_words, True)), "near_words")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("b"))
    out = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("b.m") >= factor * F.col("n"), F.col("b")).alias("b"))
    out = written(out.select("word", "n", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n")), "forms")
    roots = _roots(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def without_letter(word: Column, at: Column) -> Column:
    """The word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
