"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves that are quantised separately, so K centroids
per half give K x K cells. A query walks the cells in the order of its summed
distances to the two centroids, kept in a heap, until the cells passed hold enough
entries, and these are ranked by their exact cosine. How many are enough is
measured: for a bounded sample of queries the true neighbours are found by brute
force, and the walk goes as far as nearly all of them would have needed.

Equal vectors are one entry with its few smallest ids, so a vector that very many
rows share costs no more than any other, and ties are still told apart by id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash128, written
from .textbytes import mix

PROBES, BLOCK = 64, 8192
#: Entries that a cell should hold on average, bounds of the centroids per half, and rows per centroid to fit them on.
PER_CELL, LEAST, MOST, PER_CENTROID = 64, 4, 512, 64


def centroids_for(entries: int) -> int:
    """Centroids per half: their square is a 64th of the entries, so that cells keep their
    size as the table grows, up to 512 (from 17 million entries on cells grow again)."""
    return int(min(MOST, max(LEAST, round((entries / PER_CELL) ** 0.5))))


def blocks_of(sizes: np.ndarray, wide: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first block within its row of `wide` cells, and in how many blocks it lies.

    Neighbouring cells share a block while together they hold at most `block` entries;
    a cell with more is dealt to blocks of its own. So a query meets only the blocks
    that hold cells it asks for, however many its row has.
    """
    first, parts = np.zeros(len(sizes), dtype=np.int32), np.ones(len(sizes), dtype=np.int32)
    at = filled = 0
    for cell, n in enumerate(sizes.tolist()):
        if cell % wide == 0:
            at = filled = 0
        if filled and filled + n > block:
            at, filled = at + 1, 0
        first[cell] = at
        filled += n
        if n > block:
            parts[cell] = -(-n // block)
            at, filled = at + parts[cell], 0
    return first, parts


def visits(cells: Iterable[int], wide: int, first: np.ndarray, parts: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """The blocks (row, block) that hold the cells, each with its cells' places in the row."""
    out: dict[tuple[int, int], list[int]] = {}
    for cell in cells:
        for p in range(parts[cell]):
            out.setdefault((cell // wide, int(first[cell]) + p), []).append(cell % wide)
    return out


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample, seeded by far-apart rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng, centres = np.random.default_rng(7), [x[0]]
    near = ((x - x[0]) ** 2).sum(1)
    for _ in range(min(k, len(x)) - 1):
        total = near.sum()
        centres.append(x[rng.choice(len(x), p=near / total)] if total > 0 else x[rng.integers(len(x))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = _distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[int]:
    """All cells in the order of the summed distances to their two centroids."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]) * len(second) + int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))


def _best(scores: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best scores, ties to the smaller representative."""
    order = np.argsort(reps, kind="stable")
    top = np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(scores)), top.shape[1]), order[top].ravel()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.98, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors found nearest by cosine
    to each row of queries, its own id left out, nearest first, ties to smaller ids.

    `recall` is the share of true neighbours that the walk is set to reach, measured
    on a bounded sample of queries; `centroids` per half follow the number of entries
    (see centroids_for) unless given, and are fitted to 64 rows each, those with the
    smallest hash of their id. Every entry is indexed. Defined cases: vectors that are null, zero, of
    another length than most, or that hold null or non-finite components take no
    part, neither do null ids; with fewer than k others all are returned; rows that
    repeat an id with an equal vector count once; extra columns aren't read; empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    short = dict(vectors.dtypes)[vector_col] == dict(queries.dtypes)[vector_col] == "array<float>"
    v = F.col(vector_col).cast("array<float>" if short else "array<double>")  # floats stay as they are until they are counted with
    kind = "array<float>" if short else "array<double>"
    valid = lambda df: (
        df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    )
    h = hash128(F.col("v"))
    base = valid(vectors).select("id", "v", h[0].alias("h1"), h[1].alias("h2"))
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths["n"]
    cut = width // 2
    base = base.where(F.size("v") == width).dropDuplicates(["h1", "h2", "id"])
    turn = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = base.withColumn("turn", turn).where(F.col("turn") <= k + 1)
    entries = written(few.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")), "entries")
    centroids = centroids or centroids_for(entries.count())

    # two codebooks from a bounded sample, then every entry in its cell
    rows = entries.select("v").orderBy(F.xxhash64("rep")).limit(PER_CENTROID * centroids).toArrow().column("v").combine_chunks()
    sample = _units(_matrix(rows, width))
    books = kmeans(sample[:, :cut], centroids), kmeans(sample[:, cut:], centroids)

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = _units(x)
        return _distances(u[:, :cut], books[0]), _distances(u[:, cut:], books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = halves(_matrix(batch.column(2), width))
                cell = a.argmin(1) * len(books[1]) + b.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=["rep", "ids", "v", "cell"])

    index = written(entries.select("rep", "ids", "v").mapInArrow(place, f"rep long, ids array<long>, v {kind}, cell long"), "index")
    sizes = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    counts = written(index.groupBy("cell").count(), "cells")  # at most MOST squared rows
    got = counts.toArrow()
    sizes[got.column("cell").to_numpy()] = got.column("count").to_numpy()

    asked = valid(queries).where(F.size("v") == width).select(F.col("id").alias("query_id"), "v", h[0].alias("q1"), h[1].alias("q2")).dropDuplicates(["q1", "q2", "query_id"])
    asked = written(asked, "asked")
    kinds = asked.groupBy("q1", "q2").agg(F.min("query_id").alias("q"), F.first("v").alias("v")).select("q", "v", "q1", "q2")

    # how far the walk must go, from the true neighbours of a bounded sample of queries
    probe = kinds.select("q", "v").orderBy(F.xxhash64("q")).limit(PROBES).toArrow()
    if not probe.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    p = _matrix(probe.column("v").combine_chunks(), width)
    pn = np.linalg.norm(p, axis=1)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = _matrix(batch.column(1), width)
                s = p @ e.T / pn[:, None] / np.linalg.norm(e, axis=1)[None, :]
                r, c = _best(s, batch.column(0).to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(r), batch.column(2).take(pa.array(c)), pa.array(s[r, c])], names=["p", "cell", "score"])

    true = index.select("rep", "v", "cell").mapInArrow(exact, "p long, cell long, score double")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).collect()
    need: list[int] = []
    a, b = halves(p)
    for i in range(len(p)):
        passed, reach = 0, [r["cell"] for r in true if r["p"] == i]
        missing = set(reach)
        for cell in walk(a[i], b[i]):
            passed += int(sizes[cell])
            if cell in missing:
                need += [passed] * reach.count(cell)
                missing.remove(cell)
                if not missing:  # the last true neighbour's cell ends the walk
                    break
    # in proportion to the entries, with some to spare for queries unlike the sample
    enough = int(np.quantile(need, recall)) if need else int(sizes.sum())
    enough = max(enough, k + 1)

    wide = len(books[1])
    first, parts = blocks_of(sizes, wide)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's blocks, by the first half's centroid (the index's row), with the cells it asks for there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = halves(_matrix(batch.column(1), width))
            at, row, block, to = [], [], [], []
            for i in range(batch.num_rows):
                passed, mine = 0, []
                for cell in walk(a[i], b[i]):
                    if sizes[cell]:
                        mine.append(cell)
                        passed += sizes[cell]
                    if passed >= enough:
                        break
                met = visits(mine, wide, first, parts)
                at += [i] * len(met)
                row += [r for r, _ in met]
                block += [x for _, x in met]
                to += met.values()
            for s in range(0, len(at), 20_000):
                e = s + 20_000
                rows = pa.array(at[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(row[s:e], pa.int64()), pa.array(block[s:e], pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(to[s:e], pa.list_(pa.int32()))], names=["row", "block", "q", "v", "cells"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry's block, by its hash where its cell lies in several."""
        for batch in batches:
            cell = batch.column(3).to_numpy()
            part = mix(batch.column(0).to_numpy().view(np.uint64)) % parts[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cell // wide), pa.array(first[cell] + part.astype(np.int64)), *batch.columns[:3], pa.array((cell % wide).astype(np.int32))], names=["row", "block", "rep", "ids", "v", "cell"])

    # entries and queries meet in blocks of bounded size: whole cells of a row, or parts of a full cell
    left = index.select("rep", "ids", "v", "cell").mapInArrow(deal, f"row long, block long, rep long, ids array<long>, v {kind}, cell int")
    left = left.groupBy("row", "block").agg(F.collect_list(F.struct("rep", "ids", "v", "cell")).alias("entries"))
    n = asked.count()
    probes = kinds.select("q", "v").repartition(max(spark.sparkContext.defaultParallelism, n // 256), "q").mapInArrow(cells, f"row long, block long, q long, v {kind}, cells array<int>")
    right = probes.groupBy("row", "block", F.pmod(F.xxhash64("q"), F.lit(max(1, n // 512))).alias("turn")).agg(F.collect_list(F.struct("q", "v", "cells")).alias("asked"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's best entries of a row's block: cell by cell, then over all of them."""
        for batch in batches:
            for entry, ask in zip(batch.column(0), batch.column(1)):
                e, q = entry.values, ask.values
                ev, qv, reps = _units(_matrix(e.field("v"), width)), _units(_matrix(q.field("v"), width)), e.field("rep").to_numpy()
                order = np.argsort(e.field("cell").to_numpy(), kind="stable")
                ends = np.searchsorted(e.field("cell").to_numpy()[order], np.arange(wide + 1))
                lists = q.field("cells")
                asks = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
                of = lists.flatten().to_numpy()
                by = np.argsort(of, kind="stable")
                parts = []
                for group in np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if len(by) else []:
                    mine, who = order[ends[of[group[0]]] : ends[of[group[0]] + 1]], asks[group]
                    if len(mine):
                        s = qv[who] @ ev[mine].T
                        r, c = _best(s, reps[mine], k + 1)
                        parts.append((who[r], mine[c], s[r, c]))
                if parts:
                    r, c, s = (np.concatenate(x) for x in zip(*parts))
                    top = np.lexsort((reps[c], -s, r))
                    r, c, s = r[top], c[top], s[top]
                    best = np.arange(len(r)) - np.searchsorted(r, r) <= k
                    yield pa.RecordBatch.from_arrays([q.field("q").take(pa.array(r[best])), e.field("ids").take(pa.array(c[best])), pa.array(s[best])], names=["q", "ids", "score"])

    # both sides grow with the table, which a size estimate from before the walk doesn't show
    found = left.hint("merge").join(right, ["row", "block"]).select("entries", "asked").mapInArrow(rank, "q long, ids array<long>, score double")
    best = found.select("q", F.explode("ids").alias("vec_id"), "score")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    each = asked.select("query_id", "q1", "q2").join(kinds.select("q1", "q2", "q"), ["q1", "q2"]).select("query_id", "q")
    out = each.join(best, "q").where("vec_id != query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
