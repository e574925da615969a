"""Line deduplication across documents.

Lines are exploded, normalised and hashed; a hash found in enough documents loses
its lines everywhere but in the document with the largest id; the kept lines are
put together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, fresh, hash128, written

#: So many of the most frequent keys, whose lines are dealt to this many tasks each.
HOT_KEYS, HOT_PARTS = 1000, 64


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Returns docs with `text_col` reduced to the kept lines, and n_lines (before
    dropping) and n_dropped (long).

    A line's key is the line stripped of white space at both ends and lower-cased
    (A-Z). Keys of at least `min_chars` code points found in at least `min_docs`
    documents (distinct ids) are dropped except in the largest id.

    Defined cases: a null or empty text is one empty line and its kept text is
    empty. Rows with the same id count as one document for the threshold, and each
    row is treated and returned by itself, repeated rows too. Rows with a null id
    count as no document, but lose the lines that others do. A line repeated in the
    largest document stays there each time. Extra columns pass through, except that
    n_lines and n_dropped replace columns of these names. An empty table gives an
    empty table.

    The `HOT_KEYS` most frequent keys, a list of fixed length (ties by hash), go to all tasks, so that
    their lines are dealt to `HOT_PARTS` parts each; any other key has at most one in
    `HOT_KEYS` of all lines.
    """
    t = fresh(docs.columns)
    base = docs.drop("n_lines", "n_dropped").withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    row_hash = hash128(F.col(text_col))
    key = F.btrim(F.col(f"{t}line"), F.lit(SPACES))
    lines = (
        base.where(F.char_length(text_col) >= min_chars)
        .select(F.col(id_col).alias(f"{t}id"), row_hash[0].alias(f"{t}r1"), row_hash[1].alias(f"{t}r2"), F.posexplode(F.split(text_col, "\n", -1)).alias(f"{t}pos", f"{t}line"))
        .where(F.char_length(f"{t}line") >= min_chars)
        .withColumn(f"{t}line", key)
        .where(F.char_length(f"{t}line") >= min_chars)
        .withColumn(f"{t}line", ascii_lower(F.col(f"{t}line")))
    )
    h = hash128(F.col(f"{t}line"))
    lines = lines.select(f"{t}id", f"{t}r1", f"{t}r2", f"{t}pos", h[0].alias(f"{t}h1"), h[1].alias(f"{t}h2"))
    pair = [f"{t}h1", f"{t}h2"]
    common = (
        lines.groupBy(*pair)
        .agg(F.count_distinct(f"{t}id").alias(f"{t}n"), F.max(f"{t}id").alias(f"{t}keeper"), F.count("*").alias(f"{t}rows"))
        .where(F.col(f"{t}n") >= min_docs)
    )
    common = written(common, "common_lines")
    hot = F.broadcast(common.orderBy(F.desc(f"{t}rows"), *pair).limit(HOT_KEYS).select(*pair, F.lit(True).alias(f"{t}hot")))
    parts = F.when(F.col(f"{t}hot"), F.lit(HOT_PARTS)).otherwise(1)
    keepers = common.join(hot, pair, "left").select(*pair, f"{t}keeper", F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"{t}part"))
    dealt = lines.join(hot, pair, "left").withColumn(f"{t}part", F.pmod(F.hash(f"{t}id", f"{t}r1", f"{t}pos"), parts)).drop(f"{t}hot")
    dropped = (
        dealt.join(keepers, [*pair, f"{t}part"])
        .where(~F.col(f"{t}id").eqNullSafe(F.col(f"{t}keeper")))
        .groupBy(f"{t}id", f"{t}r1", f"{t}r2")
        .agg(F.array_sort(F.collect_set(f"{t}pos")).alias(f"{t}gone"))
    )
    base = base.withColumns({f"{t}b1": row_hash[0], f"{t}b2": row_hash[1]})
    joined = base.join(dropped, (F.col(id_col).eqNullSafe(F.col(f"{t}id"))) & (F.col(f"{t}b1") == F.col(f"{t}r1")) & (F.col(f"{t}b2") == F.col(f"{t}r2")), "left")
    parts = F.split(text_col, "\n", -1)
    # the runs of lines between dropped ones, so that the cost stays linear in a text's lines
    kept = F.expr(f"""
        array_join(flatten(transform(sequence(0, size({t}gone)), i -> slice({t}lines,
            if(i = 0, 0, try_element_at({t}gone, i) + 1) + 1,
            if(i = size({t}gone), size({t}lines), try_element_at({t}gone, i + 1)) - if(i = 0, 0, try_element_at({t}gone, i) + 1)))), '\\n')""")
    out = joined.withColumn(f"{t}lines", parts)
    return out.select(
        *[F.when(F.col(f"{t}gone").isNull(), F.col(text_col)).otherwise(kept).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in base.columns if not c.startswith(t)],
        F.size(f"{t}lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(f"{t}gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
