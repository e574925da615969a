"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of short band keys are computed per document; the tables'
keys are all pairs of one key from each collection, so `bands` x `bands` tables
need only 2 x `bands` x `rows` minhashes. A candidate pair shares a key of the
first collection and one of the second. Every link is confirmed on the full
shingle sets.

Work on large groups stays in proportion to the group as far as the result allows:
documents with equal sets are one class from the start; each class is first
compared with the most central class of its tables only; then, in a few rounds,
with the likeliest of a few classes drawn from other components; and at last only
classes that are still in different components are compared with one another, each
pair once. That last step is exact: no table is capped and no candidate left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_of, in_bitmap, written
from .components import connected_components
from .textbytes import Powers, _splitmix, chunks, grams, mix, word_hashes

#: With 12 bands of 2 rows in each collection a pair of similarity 0.8 shares no table with a chance of 1e-5.
BANDS, ROWS = 12, 2
#: Bits of the parity sketch that rules out pairs below the threshold before their sets are fetched.
SKETCH = 1024
#: Rounds in which each class is compared with one of another component, and how many are drawn per key to choose it from.
DRAWS, DRAWN = 1, 4


def _row_sets(column: pa.Array, words: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and the sorted distinct shingle hashes of each text."""
    pw = Powers()
    for a, b, data, offsets in chunks(column):
        hashes, rows = grams(*word_hashes(data, offsets, pw), words)
        ends = np.searchsorted(rows, np.arange(b - a + 1))
        for r in range(b - a):
            if wanted is None or wanted[a + r]:
                x = np.sort(hashes[ends[r] : ends[r + 1]])
                yield a + r, x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text) to (id, n, d1, d2, sig): the set's size, a 128-bit digest of the
    set and its minhashes, from whole texts."""
    k = 2 * bands * rows
    mult, add = _splitmix(k, 77) | np.uint64(1), _splitmix(k, 78)
    kind = dict((f.name, f.dataType) for f in docs.schema.fields)["id"]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")), T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n, digests, sig = np.zeros(m, np.int64), np.zeros((2, m), np.uint64), np.zeros((m, k), np.uint32)
            for r, x in _row_sets(batch.column(1), words):
                n[r] = len(x)
                if len(x):
                    digests[0, r], digests[1, r] = mix(x).sum(), mix(x ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum()
                    least = np.full(k, 0xFFFFFFFF, np.uint32)
                    for i in range(0, len(x), 4096):
                        part = x[i : i + 4096]
                        least = np.minimum(least, ((part[None, :] * mult[:, None] + add[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
                    sig[r] = least
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), pa.array(sig.reshape(-1).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(d.view(np.int64)) for d in digests), lists], names=["id", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(run, schema)


def _sketch(x: np.ndarray) -> np.ndarray:
    """The parity of the set's members in each of SKETCH slots.

    Every member that only one of two sets has changes one bit, so two sketches
    differ in at most as many bits as the sets differ in members: a filter on that
    number loses no link.
    """
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set, bits) of the documents whose id is in ids (and perhaps of a few others)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, "id"))

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            at, sets, size = [], [], 0
            for r, x in _row_sets(batch.column(1), words):
                at.append(r)
                sets.append(x)
                size += len(x)
                if size > 500_000 or r == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists(sets), lists([_sketch(x) for x in sets])], names=["id", "set", "bits"])
                    at, sets, size = [], [], 0

    return docs.where(F.col("id").isNotNull()).mapInArrow(run, "id long, set array<long>, bits array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", both.alias("x"), (F.size("sa") + F.size("sb")).alias("y")).where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("y") - F.col("x"))).select("a", "b")


def _distance(x: Column, y: Column) -> Column:
    """The number of bits in which two sketches differ, at most that of members."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))


def _apart(alive: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
    """A row per class and first key, for the keys that still join different components."""
    apart = alive.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "n", "first", "second", F.coalesce("component", "rep").alias("label"))
    spread = apart.select("rep", "label", F.explode("first").alias("key"))
    mixed = spread.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return written(apart.join(bits, "rep").select("*", F.explode("first").alias("key")).join(mixed, "key"), "side")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row per row of docs.

    Words are runs without white space, lower-cased (A-Z); a document's set has the
    distinct shingles of `words` words, or its whole sequence where it has fewer.
    Documents with at least `percent` per cent of the union in common are linked,
    and a component is named by its smallest id, which alone is kept. The id column
    is an integer.

    Defined cases: null, empty and wordless texts have an empty set and are linked
    with nothing. Rows are judged by their texts: rows that repeat an id are each
    returned. Rows with a null id are linked with nothing, have a null component
    and are kept. Extra columns aren't read. An empty table gives an empty table.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = written(signatures(slim, words, bands, rows), "signatures")
    full = sig.where("n > 0 and id is not null")
    reps = written(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(2 * bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, F.lit(rows))))
    half = reps.select("rep", F.posexplode(keys).alias("band", "key"))
    shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    alive = (
        half.join(shared, "key")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.when(F.col("band") < bands, F.col("key")))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("band") >= bands, F.col("key")))).alias("second"), F.sum("c").alias("score"))
        .where((F.size("first") > 0) & (F.size("second") > 0))
    )
    alive = written(alive.join(reps.select("rep", "n"), "rep"), "alive")

    # each class and the most central one that it shares a table with
    tables = alive.select("rep", "score", F.explode(F.flatten(F.transform("first", lambda x: F.transform("second", lambda y: F.xxhash64(x, y))))).alias("key"))
    centre = tables.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("neg"))).alias("top"), F.count("*").alias("c")).where("c > 1")
    star = (
        tables.join(centre.select("key", "top"), "key")
        .where("rep != -top.neg")
        .groupBy("rep")
        .agg((-F.max("top")["neg"]).alias("b"))
        .select(F.col("rep").alias("a"), "b")
    )
    star = written(star, "star")
    sets = written(shingle_sets(slim, alive.select(F.col("rep").alias("id")), words), "sets")
    pairs_of = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = lambda labels, more: connected_components(labels.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(pairs_of(more)))  # noqa: E731  components so far are stars already
    labels = connected_components(pairs_of(confirmed(star, sets, percent)))

    bits = sets.select(F.col("id").alias("rep"), "bits")
    near_enough = lambda d, m, n: d * (100 + percent) <= (m + n) * (100 - percent)  # noqa: E731  that many members may differ
    for turn in range(DRAWS):
        side = _apart(alive, labels, bits)
        drawn = [F.max(F.struct(F.xxhash64("rep", F.lit(turn * DRAWN + i)).alias("h"), "rep", "label", "bits", "n")) for i in range(DRAWN)]
        # "key" stands for the members of one first key; each class takes the likeliest of those drawn there
        best = F.array_min(F.transform("drawn", lambda d: F.when(d["label"] != F.col("label"), F.struct(_distance(F.col("bits"), d["bits"]).alias("d"), d["rep"].alias("b"), near_enough(_distance(F.col("bits"), d["bits"]), F.col("n"), d["n"]).alias("near")))))
        near = (
            side.join(side.groupBy("key").agg(F.array(*drawn).alias("drawn")), "key")
            .select("rep", best.alias("best"))
            .groupBy("rep")
            .agg(F.min("best").alias("best"))
            .where("best.near")
            .select(F.col("rep").alias("a"), F.col("best.b").alias("b"))
        )
        labels = joined(labels, confirmed(near, sets, percent))

    # what is still apart, each pair once: in the first key of the first collection that both have
    side = _apart(alive, labels, bits)
    x, y = side.alias("x"), side.alias("y")
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n"))
        & near_enough(_distance(F.col("x.bits"), F.col("y.bits")), F.col("x.n"), F.col("y.n"))
        & F.arrays_overlap("x.second", "y.second")
        & (F.array_min(F.array_intersect("x.first", "y.first")) == F.col("x.key")),
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    labels = joined(labels, confirmed(written(pairs, "pairs"), sets, percent))

    of_class = reps.join(labels, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    named = sig.select("id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
