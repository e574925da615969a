"""The best offset of a target inside a larger grid, found without comparing all cells at all offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmeld.operators.fields import full_grid, present
from gridmeld.sources.scratch import written

#: A map's cells are dealt to so many parts where they meet its offsets, so that one large map is many tasks' work.
PARTS = 64
#: Eighths of the target that have been compared after each round, before the whole of it is.
ROUNDS = (1, 4)


def pieces(target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, x, k, n_want, want): the runs of neighbouring cells in the rows of a target, cut into
    pieces of 2^k cells from x on, with the sum of their values. Cells come once each.

    A run of n cells has a piece for every bit of n that is set, the longest first; cell i of it
    lies in the piece of the highest bit in which i and n differ.
    """
    row = Window.partitionBy(*keys, "y")
    runs = target.withColumn("__run", F.col("x") - F.row_number().over(row.orderBy("x")))
    run = Window.partitionBy(*keys, "y", "__run")
    runs = runs.withColumns({"__i": F.col("x").cast("long") - F.min("x").over(run), "__n": F.count("*").over(run)})
    runs = runs.withColumn("k", F.length(F.bin(F.col("__i").bitwiseXOR(F.col("__n")))) - 1)
    return runs.groupBy(*keys, "y", "__run", "k").agg(F.min("x").alias("x"), F.count("*").alias("n_want"), F.sum("value").alias("want")).drop("__run")


def spans(raw: DataFrame, most: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, x, k, lo, hi, total, n): of the 2^k cells from x on, for every x and all k up to
    `most`, the least and the largest value, the sum and the number; those without cells are left out.

    Each level is made of the one before and of itself shifted by its length, within one sort of the rows.
    """
    k = list(keys)
    ends = raw.groupBy(*k, "y").agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    dense = ends.select(*k, "y", F.explode(F.sequence(F.col("__a") - (2**most - 1), F.col("__b"))).alias("x"))
    cells = dense.join(raw.select(*k, "y", "x", "value"), [*k, "y", "x"], "left")
    cells = cells.select(*k, "y", "x", F.col("value").alias("lo0"), F.col("value").alias("hi0"), F.coalesce("value", F.lit(0.0)).alias("total0"), F.col("value").isNotNull().cast("int").alias("n0"))
    row = Window.partitionBy(*k, "y").orderBy("x")
    for i in range(most):
        on = lambda c: F.lead(f"{c}{i}", 2**i).over(row)  # noqa: B023, E731
        cells = cells.withColumns({
            f"lo{i + 1}": F.least(f"lo{i}", on("lo")), f"hi{i + 1}": F.greatest(f"hi{i}", on("hi")),
            f"total{i + 1}": F.col(f"total{i}") + F.coalesce(on("total"), F.lit(0.0)), f"n{i + 1}": F.col(f"n{i}") + F.coalesce(on("n"), F.lit(0)),
        })
    levels = [F.struct(F.lit(i).alias("k"), *[F.col(f"{c}{i}").alias(c) for c in ("lo", "hi", "total", "n")]) for i in range(most + 1)]
    return cells.select(*k, "y", "x", F.inline(F.array(*levels))).where("n > 0")


def find_offset(raw: DataFrame, target: DataFrame, most_dy: int, most_dx: int, keys: Sequence[str] = (), complete_only: bool = True, trace: list[int] | None = None) -> DataFrame:
    """(keys, dy, dx, n_valid, diff, n_tried): the row of `fields.offset_errors` with the least difference
    per map, ties to the first in row order, and the number of offsets at which all cells were compared.

    The range of a patch and a lower bound of its difference come from sums over pieces of
    the target's rows: a sum of differences is at least the difference of the sums. The most
    promising offset of a map is then compared in full, and what cannot be better is dropped; in the
    same way after an eighth and after half of the cells. What is left is compared in full.
    Where all offsets differ about alike none can be dropped, and the work is that of comparing all cells at all offsets.
    Cells come once each; absent values don't count; maps without a valid offset have no row.
    `trace` gets the numbers of rows that the joins of pieces and of cells gave.
    """
    spark, k = raw.sparkSession, list(keys)
    own = [c for c in k if c in target.columns]
    raw = written(present(raw).select(*k, "y", "x", F.col("value").cast("double").alias("value")))
    target = written(present(target).select(*own, "y", "x", F.col("value").cast("double").alias("value")))
    cut = written(pieces(target, own))
    most, y0, y1, x0, x1 = cut.agg(F.max("k"), F.min("y"), F.max("y"), F.min("x"), F.max(F.col("x") + F.col("n_want"))).first()
    table = written(spans(raw, most or 0, k))
    offsets = full_grid(spark, most_dy + 1, most_dx + 1).select(F.col("y").alias("dy"), F.col("x").alias("dx"))
    moved = cut.crossJoin(F.broadcast(offsets)).select(*own, "dy", "dx", "k", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "want", "n_want")
    met = moved.join(table, [*own, "y", "x", "k"])
    at = [*k, "dy", "dx"]
    ranges = met.groupBy(*at).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_valid"))
    if complete_only:
        sizes = target.groupBy(*own).agg(F.count("*").alias("__n"))
        ranges = (ranges.join(sizes, own) if own else ranges.crossJoin(F.broadcast(sizes))).where("n_valid = __n").drop("__n")
    ranges = written(ranges)
    over = ranges.withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("total") - F.col("n") * F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col("total"))
    least = F.when(F.col("n") == F.col("n_want"), F.abs(scaled - F.col("want"))).otherwise(0.0)
    bounds = met.join(over, at).groupBy(*at).agg(F.sum(least).alias("bound"))
    # sums of large values in a small range lose digits, which a bound must not gain
    slack = F.lit(1e-9) * (1 + F.when(F.col("hi") > F.col("lo"), F.greatest(F.abs("lo"), F.abs("hi")) / (F.col("hi") - F.col("lo"))).otherwise(F.greatest(F.abs("lo"), F.abs("hi"))))
    live = written(ranges.join(bounds, at).select(*at, "lo", "hi", "n_valid", "bound", slack.alias("slack"), F.lit(float("inf")).alias("top")))
    if trace is not None:
        trace.append(2 * met.count())

    def compared(some: DataFrame, eighths: tuple[int, int] = (0, 8)) -> DataFrame:
        """The cells of the target's given eighths with those of raw under them, at some offsets."""
        dealt = some.select(*at, "lo", "hi").withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        both = raw.withColumn("__p", F.pmod(F.xxhash64("y", "x"), F.lit(PARTS)).cast("int")).join(dealt, [*k, "__p"]).drop("__p")
        both = both.withColumns({"y": F.col("y") - F.col("dy"), "x": F.col("x") - F.col("dx")})
        if y0 is not None:
            both = both.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
        if eighths != (0, 8):
            both = both.where(F.pmod(F.xxhash64("x", "y"), F.lit(8)).between(eighths[0], eighths[1] - 1))
        both = both.join(target.withColumnRenamed("value", "want"), [*own, "y", "x"])
        if trace is not None:
            trace.append(both.count())
        scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.col("value"))
        return both.select(*at, F.abs(scaled - F.col("want")).alias("__d"))

    def pruned(live: DataFrame) -> DataFrame:
        """What may still be better than the most promising offset of its map, compared in full."""
        first = live.groupBy(*k).agg(F.min_by(F.struct("dy", "dx", "lo", "hi"), F.struct(F.col("bound") / F.col("n_valid"), "dy", "dx")).alias("b")).select(*k, "b.*")
        full = compared(written(first)).groupBy(*k).agg(F.avg("__d").alias("__top"))
        out = live.join(full, k, "left") if k else live.crossJoin(F.broadcast(full))  # one row per map
        out = out.withColumn("top", F.least("top", "__top")).drop("__top")
        return written(out.where(F.col("bound") / F.col("n_valid") <= F.col("top") + F.col("slack")))

    done = 0
    live = pruned(live)
    for upto in ROUNDS:
        sums = compared(live, (done, upto)).groupBy(*at).agg(F.sum("__d").alias("__s"))
        sofar = F.coalesce("__s", F.lit(0.0)) + (F.col("sum") if done else F.lit(0.0))
        live = live.join(sums, at, "left").withColumn("sum", sofar).withColumn("bound", F.greatest("bound", "sum")).drop("__s")
        live, done = pruned(written(live)), upto
    errors = compared(live).groupBy(*at).agg(F.avg("__d").alias("diff")).join(live.select(*at, "n_valid"), at)
    best = errors.groupBy(*k).agg(F.min(F.struct("diff", "dy", "dx", "n_valid")).alias("b"), F.count("*").alias("n_tried"))
    return best.where("n_tried > 0").select(*k, "b.dy", "b.dx", "b.n_valid", "b.diff", "n_tried")
