"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target words
over the source's words). These are summed in size order within the source, one
offset is added, and a document is emitted once for each integer boundary that its
stretch of the running sum crosses. Size order makes each stretch of the sizes
give its share, so a source's taken words stay within about one long document of
its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, written

_T = "__gridmeld_"
WORD = r"[^\x20\x09-\x0D]+"
_UNIT = float(1 << 32)
#: Copies of equal rows that one task writes.
PORTION = 10_000


def word_count(text) -> "F.Column":
    """The number of runs of characters that are not white space; null counts as 0.

    Counting the places where a word begins needs no array of words.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from (source, source_size): adds weight and target.

    Sources in code point order, null last, get the weights in turn and share
    `share` times all words; a target stops at `most` times its source's words and
    the excess is shared again by weight until none is above. That end state has
    one level: every target is min(most * size, level * weight), and the sources
    below their limit are the last ones in the order of limit over weight. One row
    per source, so the two small windows over all sources are sums of counts, not
    of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.lit(list(map(float, weights)))
    ranked = sizes.withColumn("weight", F.element_at(w, (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * most)
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # a source is at its limit if the level that holds once all before it are, still lies above it
    level = F.min(F.when(F.col("limit") / F.col("weight") > F.col("left") / F.col("open"), F.struct(F.col("limit") / F.col("weight"), F.col("left") / F.col("open"))))
    return (
        ranked.withColumn("level", level.over(every)["col2"])
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("limit") / F.col("weight") <= F.col("level")), F.col("limit")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def _row_key(id_col: str, text_col: str, source_col: str) -> list:
    """Two hashes of a row's id, source and text, nulls told apart."""
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x5BD1E995), *parts)]


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: (id, source, k1, k2, size, source_size,
    target, copies), one row per row of docs; k1 and k2 hash the row.

    Ranks within a source come from a range partitioning by (source, size, id, row
    hash) and from the partitions' counts, so that a source with a third of all rows
    spreads over many tasks: a row's place in its partition is the running number that
    Spark gives it, less the first of its source there. The texts are read once, for
    the slim rows. Defined cases: null
    texts and texts without words have size 0 and are taken like the others, adding
    no words; a source whose words are all 0 has target 0 and is not taken; null ids
    and repeated rows are rows like any other; null is a source of its own.
    """
    k = _row_key(id_col, text_col, source_col)
    slim = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(id_col).alias("id"), k[0].alias("k1"), k[1].alias("k2"))
    slim = written(slim.withColumn(f"{_T}row", F.monotonically_increasing_id()), "sizes")
    order = ["source", "size", "id", "k1", f"{_T}row"]  # the last lets a row that repeats very often fill several ranges
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(ordered.withColumn(f"{_T}at", F.monotonically_increasing_id()), "ranked").withColumn(f"{_T}part", F.shiftright(f"{_T}at", 33))
    parts = ranked.groupBy("source", f"{_T}part").agg(F.min(f"{_T}at").alias("first"), F.count("*").alias("rows"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy(f"{_T}part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / _UNIT
    bases = (
        parts.select(F.col("source").alias("s"), F.col(f"{_T}part").alias("p"), (F.col("base") - F.col("first") + 1).alias("base"))
        .join(targets.withColumn("offset", offset), F.col("s").eqNullSafe(F.col("source")))
        .select("s", "p", "base", "source_size", "target", "offset")
    )
    rank = F.col("base") + F.col(f"{_T}at")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("offset") + rate * rank) - F.floor(F.col("offset") + rate * (rank - 1))
    return (
        ranked.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col(f"{_T}part") == F.col("p")))
        .select("id", "source", "k1", "k2", "size", "source_size", "target", copies.alias("copies"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as mix_plan() says, with
    the columns of docs and a long column `copy` (from 1) that replaces one of that
    name.

    Which rows repeat is told by slim keys, so texts of single rows meet their plan by
    a join and nothing else. Rows that agree in id, source and text follow one another
    in the plan, so they are taken equally often but for one copy. Of these, rows
    equal in every column are one row with a number before any shuffle by key, and
    what is taken of them is dealt out again in portions of PORTION copies; rows that
    differ in other columns share by a running sum of these numbers.
    """
    cols = [c for c in docs.columns if c != "copy"]
    quoted = [F.col(f"`{c}`") for c in cols]
    own = fresh(docs.columns)
    k1, k2, turn, number, m, t = (f"{own}{x}" for x in ("k1", "k2", "turn", "number", "rows", "taken"))
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    plan = plan.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count("*").alias(m), F.sum("copies").alias(t)).where(F.col(t) > 0)
    plan = written(plan, "copies")
    k = _row_key(id_col, text_col, source_col)
    keyed = docs.select(*quoted, k[0].alias(k1), k[1].alias(k2))
    one = F.lit(1).cast("long")
    single = keyed.join(plan.where(F.col(m) == 1), [k1, k2]).select(*quoted, F.explode(F.sequence(one, t)).alias("copy"))

    # repeated rows: one of each kind with its number, then copies in portions
    many = keyed.join(plan.where(F.col(m) > 1), [k1, k2])
    kind = F.xxhash64(F.to_json(F.struct(*quoted)))
    kinds = many.groupBy(k1, k2, kind.alias(f"{own}kind")).agg(F.count("*").alias(number), F.first(F.struct(*quoted, m, t)).alias(f"{own}row"))
    kinds = kinds.select(f"{own}row.*", k1, k2, f"{own}kind", number)
    before = F.sum(number).over(Window.partitionBy(k1, k2).orderBy(f"{own}kind")) - F.col(number)
    # the first `taken mod rows` of the rows get one copy more than the others
    whole, rest = F.floor(F.col(t) / F.col(m)), F.pmod(F.col(t), F.col(m))
    more = F.greatest(F.lit(0), F.least(F.col(number), rest - F.col(f"{own}before")))
    shares = kinds.withColumn(f"{own}before", before).withColumn(turn, whole * F.col(number) + more).where(F.col(turn) > 0)
    portions = shares.withColumn(f"{own}from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(turn) - 1, F.lit(PORTION).cast("long"))))
    portions = portions.repartition(k1, k2, f"{own}from")
    each = portions.withColumn(f"{own}i", F.explode(F.sequence(F.col(f"{own}from"), F.least(F.col(turn), F.col(f"{own}from") + PORTION) - 1)))
    repeated = each.select(*quoted, (F.floor(F.col(f"{own}i") / F.col(number)) + 1).cast("long").alias("copy"))
    return single.unionByName(repeated)
