"""Ranks, top-k and rank correlation without a single-partition sort.

A rank is worked out in two phases: rows are dealt to ranges of the value by sampled
edges, ranked within each (keys, range), and shifted by the counts of the ranges before.
Any edges give right ranks. A value that fills ranges by itself, and null, is a range of
its own, which is split by the column that orders ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType
from pyspark.sql.window import Window

from gridmeld.functions.expressions import edges_below
from gridmeld.sources.scratch import written

#: Rows that a range should hold, and the most ranges of a level; there are two levels.
PER_RANGE, MOST_RANGES = 250_000, 256


def range_cuts(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> list[list]:
    """Edges of the ranges of each column and, as the last item, the number of rows, from
    one aggregate. Their number follows the number of rows unless given.

    Beyond `MOST_RANGES` ranges each one is cut again by the quantiles of its own rows, so
    there can be MOST_RANGES^2, and a range holds about `PER_RANGE` rows up to 16 billion rows.
    """
    probs = lambda n: [i / n for i in range(1, n)]
    row = df.agg(F.count("*"), *[F.percentile_approx(c, probs(MOST_RANGES), 10_000) for c in columns]).first()
    n = buckets or row[0] // PER_RANGE + 1
    at = sorted({round(i * MOST_RANGES / n) - 1 for i in range(1, n)} - {-1}) if n <= MOST_RANGES else range(MOST_RANGES - 1)
    cuts = [[q[i] for i in at if q[i] == q[i]] if q else [] for q in row[1:]]
    parts = min(MOST_RANGES, -(-n // MOST_RANGES))
    if parts > 1:
        for c, own in zip(columns, cuts):
            inner, single = edges_below(F.col(c), sorted(set(own)), strict=True), {x for x, y in zip(own, own[1:]) if x == y}
            found = df.where(F.col(c).isNotNull() & ~F.col(c).isin(sorted(single))).groupBy(inner.alias("b")).agg(F.percentile_approx(c, probs(parts), 10_000).alias("q")).collect()  # a row per range
            own += [x for r in found for x in r["q"] if x == x]
            own.sort()
    return [*cuts, row[0]]


def located(df: DataFrame, value: str, cuts: list, name: str, one: str | None = None) -> DataFrame:
    """Adds the number of distinct edges strictly below the value (null for null), and whether
    the value is a repeated edge. Edges that are too many for the plan come in a table of
    at most MOST_RANGES rows, one for each stretch of edges."""
    edges, single = sorted(set(cuts)), {c for c, d in zip(cuts, cuts[1:]) if c == d}
    v = F.col(value)
    if len(edges) < MOST_RANGES:
        out = df.withColumn(name, edges_below(v, edges, strict=True))
        return out.withColumn(one, v.isin(sorted(single)) if single else F.lit(False)) if one else out
    step = -(-len(edges) // MOST_RANGES)
    stretches = [(i, edges[i * step : (i + 1) * step], [e in single for e in edges[i * step : (i + 1) * step]]) for i in range(-(-len(edges) // step))]
    book = df.sparkSession.createDataFrame([(i, [float(e) for e in es], s) for i, es, s in stretches], "__i int, __es array<double>, __single array<boolean>")
    last = [es[-1] for _, es, _ in stretches]
    powers = [1 << k for k in reversed(range(step.bit_length()))]
    x = v.cast("double")
    # by halving: steps are taken as long as the edge before them is below the value
    inner = F.aggregate(F.lit(powers), F.lit(0), lambda n, p: F.when((n + p <= F.size("__es")) & (F.get("__es", n + p - 1) < x), n + p).otherwise(n))
    out = df.withColumn("__j", F.least(edges_below(v, last, strict=True), F.lit(len(last) - 1))).join(F.broadcast(book), F.col("__j") == F.col("__i"), "left").withColumn("__in", inner)
    out = out.withColumn(name, F.when(v.isNotNull(), F.col("__j") * step + F.col("__in")))
    if one:
        out = out.withColumn(one, F.coalesce((F.get("__es", F.col("__in")) == x) & F.get("__single", F.col("__in")), F.lit(False)))
    return out.drop("__i", "__j", "__in", "__es", "__single")


def ranged(df: DataFrame, value: str, tie: str, cuts: list, tie_cuts: list, nulls_first: bool = False) -> DataFrame:
    """Adds __b, the range (odd and the one of nulls: rows of one value), and __s, its part by the
    tie column. Both together rise with (value, tie)."""
    last = -2 if nulls_first else 2 * len(set(cuts)) + 2
    out = located(df, value, cuts, "__p", "__single_value")
    out = out.withColumn("__b", F.when(F.col("__p").isNull(), F.lit(last)).otherwise(2 * F.col("__p") + F.col("__single_value").cast("int"))).drop("__p", "__single_value")
    out = out.withColumn("__one", (F.col("__b") % 2 == 1) | (F.col("__b") == last))
    if not tie_cuts:
        return out.withColumn("__s", F.lit(0))
    out = located(out, tie, tie_cuts, "__t")
    return out.withColumn("__s", F.when(F.col("__one"), F.coalesce(F.col("__t"), F.lit(-1))).otherwise(F.lit(0))).drop("__t")


def with_ranks(df: DataFrame, value: str, names: Mapping[str, tuple[str, bool]], keys: Sequence[str] = (), tie: str = "id", buckets: int | None = None, cuts: tuple[list, list] | None = None) -> DataFrame:
    """Adds several 1-based ranks of one column at once: name -> (method, descending) with
    the methods `average` (ties share their mean rank), `ordinal` (ties in order of the
    column tie), `min`, `dense`, and `size` (the rows of the group).

    Nulls come last in either direction, as equals; NaN is greater than every number.
    All ranks come from one sort. df is read three times (edges, counts, rows), so an
    expensive one should be a written table. `cuts` spares the first of these.
    """
    k, dense = list(keys), any(m == "dense" for m, _ in names.values())
    cuts = cuts or range_cuts(df, [value, tie], buckets)[:2]
    work = ranged(df, value, tie, *cuts)
    null = 2 * len(set(cuts[0])) + 2
    kinds = F.when(F.first("__one"), F.lit(1).cast("long")).otherwise(F.count_distinct(value)) if dense else F.lit(0).cast("long")
    counts = work.groupBy(*k, "__b", "__s").agg(F.count("*").alias("__n"), kinds.alias("__d"))
    group, of_b = Window.partitionBy(*k), Window.partitionBy(*k, "__b")
    before = group.orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__d", F.when(F.row_number().over(of_b.orderBy("__s")) == 1, F.col("__d")).otherwise(0))
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__kinds": F.coalesce(F.sum("__d").over(before), F.lit(0))})
    real = lambda c: F.coalesce(F.sum(F.when(F.col("__b") != null, F.col(c))).over(group), F.lit(0))
    base = counts.select(
        *[F.col(c).alias(f"__k_{c}") for c in k], F.col("__b").alias("__k_b"), F.col("__s").alias("__k_s"), "__before",
        F.min("__before").over(of_b).alias("__low"), F.sum("__n").over(of_b).alias("__same"), F.min("__kinds").over(of_b).alias("__kinds"),
        real("__n").alias("__real"), real("__d").alias("__real_kinds"), F.sum("__n").over(group).alias("__total"),
    )
    part = Window.partitionBy(*k, "__b", "__s")
    local = {"__place": F.row_number().over(part.orderBy(value, tie)), "__first": F.rank().over(part.orderBy(value)), "__ties": F.count("*").over(Window.partitionBy(*k, "__b", "__s", value))}
    if dense:
        local["__nth"] = F.dense_rank().over(part.orderBy(value))
    on = (F.col("__b") == F.col("__k_b")) & (F.col("__s") == F.col("__k_s"))
    for c in k:
        on &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out = work.withColumns(local).join(base, on)
    one, none = F.col("__one"), F.col("__b") == null
    low = F.col("__low") + F.when(one, 1).otherwise(F.col("__first"))
    ties = F.when(one, F.col("__same")).otherwise(F.col("__ties"))
    place = F.col("__before") + F.col("__place")
    found = {}
    for name, (method, descending) in names.items():
        first = F.when(none, low).otherwise(F.col("__real") - low - ties + 2) if descending else low
        if method == "size":
            found[name] = F.col("__total")
        elif method == "ordinal":
            found[name] = first + place - low
        elif method == "min":
            found[name] = first
        elif method == "dense":
            up = F.col("__kinds") + F.col("__nth")
            found[name] = F.when(none, up).otherwise(F.col("__real_kinds") + 1 - up) if descending else up
        else:
            found[name] = first + (ties - 1) / 2.0
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[c.alias(n) for n, c in found.items()])


def with_rank(df: DataFrame, value: str, name: str = "rank", keys: Sequence[str] = (), method: str = "average", tie: str = "id", descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds one rank; see with_ranks."""
    return with_ranks(df, value, {name: (method, descending)}, keys, tie, buckets)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "id", buckets: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row within its keys, in order (nulls first). The
    first order column must be numeric: its ranges split the keys' groups, so that a few
    large ones spread over tasks."""
    k = list(keys)
    work = located(df, order[0], range_cuts(df, [order[0]], buckets)[0], "__b").fillna(-1, "__b")
    work = work.withColumn("__r", F.row_number().over(Window.partitionBy(*k, "__b").orderBy(*order)) - 1)
    before = Window.partitionBy(*k).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = work.groupBy(*k, "__b").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    base = counts.select(*[F.col(c).alias(f"__k_{c}") for c in k], F.col("__b").alias("__k_b"), "__base")
    on = F.col("__b") == F.col("__k_b")
    for c in k:
        on &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return work.join(base, on).withColumn(name, F.col("__r") + F.col("__base")).select(*[c for c in df.columns if c != name], name)


def sum_before(df: DataFrame, order: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Adds the sum of a column over all rows before, in the order of a numeric column
    without repeats: sums within ranges plus the ranges' totals."""
    work = located(df, order, range_cuts(df, [order], buckets)[0], "__b").fillna(-1, "__b")
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy("__b").agg(F.sum(value).alias("__n"))
    totals = totals.select(F.col("__b").alias("__k_b"), F.coalesce(F.sum("__n").over(rows(Window.orderBy("__b"))), F.lit(0)).alias("__sum"))  # one row per range
    own = F.coalesce(F.sum(value).over(rows(Window.partitionBy("__b").orderBy(order))), F.lit(0))
    return work.withColumn("__r", own).join(totals, F.col("__b") == F.col("__k_b")).withColumn(name, F.col("__r") + F.col("__sum")).drop("__b", "__k_b", "__r", "__sum")


def top_k_curve(pairs: DataFrame, shares: Sequence[float], truth: str = "truth", pred: str = "pred", keys: Sequence[str] = (), tie: str = "id", higher_is_better: bool = True) -> DataFrame:
    """Overlap of the top k of truth and prediction for k = max(1, ceil(share * n)):
    (keys, share, k, overlap, recall, precision, jaccard, baseline).

    A row is in both tops exactly if the greater of its two ranks is at most k, so
    one count per greater rank serves all cut-offs.
    """
    k = list(keys)
    slim = written(pairs.select(*k, F.col(tie).alias("id"), F.col(truth).alias("truth"), F.col(pred).alias("pred")))
    *cuts, _ = range_cuts(slim, ["truth", "pred", "id"])
    ranked = with_ranks(slim, "truth", {"rt": ("ordinal", higher_is_better), "n": ("size", False)}, k, cuts=(cuts[0], cuts[2]))
    ranked = with_ranks(ranked, "pred", {"rp": ("ordinal", higher_is_better)}, k, cuts=(cuts[1], cuts[2]))
    return curve_of(ranked, shares, k)


def curve_of(ranked: DataFrame, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """top_k_curve() of rows that have their ordinal ranks rt and rp and the size n.

    A row counts for all cut-offs from the first that reaches its greater rank on, so the
    rows are counted per stretch between cut-offs and the counts added up.
    """
    k, cuts = list(keys), sorted(float(c) for c in shares)
    least = lambda c: F.greatest(F.lit(1), F.ceil(c * F.col("n"))).cast("long")
    # a rank is beyond ceil(share * n) exactly if the one before it reaches share * n
    step = edges_below(F.greatest("rt", "rp") - 1, cuts, unit=F.col("n"))
    step = F.when(F.greatest("rt", "rp") == 1, 0).otherwise(step)
    counts = ranked.groupBy(*k, "n", step.alias("step")).agg(F.count("*").alias("c"))
    steps = counts.groupBy(*k, "n").agg(F.collect_list(F.struct("step", "c")).alias("__steps"))  # at most one more than there are cut-offs
    out = steps.select(*k, "n", "__steps", F.posexplode(F.lit(cuts)).alias("__i", "share"))
    upto = F.filter("__steps", lambda s: s["step"] <= F.col("__i"))
    out = out.select(*k, "share", least(F.col("share")).alias("k"), F.aggregate(upto, F.lit(0).cast("long"), lambda n, s: n + s["c"]).alias("overlap"))
    return out.select(*k, "share", "k", "overlap", (F.col("overlap") / F.col("k")).alias("recall"), (F.col("overlap") / F.col("k")).alias("precision"), (F.col("overlap") / (2 * F.col("k") - F.col("overlap"))).alias("jaccard"), F.col("share").alias("baseline"))


def pairs_of(c: Column, exact: bool) -> Column:
    """c (c - 1) / 2 in whole numbers."""
    wide = lambda x: x.cast("decimal(19,0)") if exact else x
    half = lambda x: F.shiftright(x, 1)
    return F.when(c % 2 == 0, wide(half(c)) * wide(c - 1)).otherwise(wide(c) * wide(half(c - 1)))


def kendall(pairs: DataFrame, x: str = "truth", y: str = "pred", keys: Sequence[str] = (), per_chunk: int = PER_RANGE) -> DataFrame:
    """Kendall's tau-b per group, with the numbers of concordant, discordant and tied
    pairs, in n log n. Rows with a null take no part."""
    k = list(keys)
    cells = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*k, F.col(x).alias("rx"), F.col(y).alias("ry")).agg(F.count("*").alias("c"))
    return kendall_of(cells, k, per_chunk)


def rising_pairs(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> int:
    """The sum of c[i] * c[j] over all i and j with u[i] < u[j] and v[i] < v[j].

    In the order of v (equals by falling u, so that they don't count), two rows with different
    u part at one highest bit of u's place: for each bit, rows with it take
    the sum of those without it before them that share all higher bits.
    """
    u = np.unique(u, return_inverse=True)[1]
    order = np.lexsort((-u, np.unique(v, return_inverse=True)[1]))
    u, c, total = u[order], c[order], 0
    at = np.arange(len(u))
    for bit in reversed(range(int(u.max(initial=0)).bit_length())):
        one, block = (u >> bit & 1).astype(bool), u >> (bit + 1)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        sizes = np.diff(starts, append=len(u))
        of_start = lambda x: np.repeat(x[starts], sizes)
        below, zeros = np.cumsum(np.where(one, 0, c)), np.cumsum(~one)
        first = below - np.where(one, 0, c)
        total += int(((below - of_start(first)) * c)[one].sum())
        before = zeros - ~one - of_start(zeros - ~one)  # rows without the bit before, in the block
        place = np.where(one, of_start(at) + np.repeat(np.add.reduceat((~one).astype(np.int64), starts), sizes) + (at - of_start(at)) - before, of_start(at) + before)
        moved, weights = np.empty_like(u), np.empty_like(c)
        moved[place], weights[place] = u, c
        u, c = moved, weights
    return total


def equal_pairs(v: np.ndarray, c: np.ndarray) -> int:
    """The sum of n (n - 1) / 2 over distinct values, n being the sum of a value's c."""
    places = np.unique(v, return_inverse=True)[1]
    n = np.zeros(int(places.max(initial=-1)) + 1, c.dtype)
    np.add.at(n, places, c)
    return int((n * (n - 1) // 2).sum())


def kendall_of(cells: DataFrame, keys: Sequence[str] = (), per_chunk: int = PER_RANGE) -> DataFrame:
    """kendall() of (keys, rx, ry, c): the distinct pairs of numbers and how often each comes.

    Both sides are cut into ranges of about `per_chunk` rows. Of two concordant rows either both
    are in one range of x, or they are in different ones and in one range of y, or in different
    ones of both. The first two are counted within a range, which is one group of a task; the third
    by running sums over the numbers of rows in each range of x and of y. A value that
    fills a range by itself has no concordant pairs there, so its range isn't gathered. What isn't
    concordant follows from the ties of either side.
    """
    k, cells = list(keys), written(cells)
    rows, n = cells.agg(F.count("*"), F.sum("c")).first()
    exact = (n or 0) >= 1 << 31  # below that 64 bits hold every sum
    cuts_x, cuts_y, _ = range_cuts(cells, ["rx", "ry"], rows // per_chunk + 1)
    work = located(located(cells, "rx", cuts_x, "__px", "__ox"), "ry", cuts_y, "__py", "__oy")
    work = work.select(*k, "rx", "ry", "c", *[(2 * F.col(f"__p{s}") + F.col(f"__o{s}").cast("int")).alias(f"b{s}") for s in "xy"])
    schema = StructType([*[cells.schema[c] for c in k], StructField("met", DecimalType(38, 0)), StructField("tied", DecimalType(38, 0))])

    def within(side: str, first: str) -> DataFrame:
        """(keys, met, tied) of each range of a side: its pairs that rise in the column `first` and in y, and
        those of equal values."""

        def run(group: pa.Table) -> pa.Table:
            numbers = {name: group.column(name).to_numpy() for name in {first, "ry", f"r{side}", "c"}}
            c = numbers["c"] if sum(map(int, numbers["c"])) < 1 << 31 else numbers["c"].astype(object)
            found = [rising_pairs(numbers[first], numbers["ry"], c), equal_pairs(numbers[f"r{side}"], c)]
            return pa.table([*[group.column(name).slice(0, 1) for name in k], *[pa.array([Decimal(x)], pa.decimal128(38, 0)) for x in found]], names=[*k, "met", "tied"])

        return work.where(F.col(f"b{side}") % 2 == 0).groupBy(*k, f"b{side}").applyInArrow(run, schema)

    total = lambda c: F.sum(c).cast("decimal(38,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    on = lambda names: reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in names), F.lit(True))
    marked = lambda df, names: df.withColumnsRenamed({c: f"__k_{c}" for c in names})
    joined = lambda a, b, how="inner": a.join(marked(b, k), on(k), how).drop(*[f"__k_{c}" for c in k]) if k else a.crossJoin(b)
    # all ranges of x with all of y, their rows, and the rows in lower ranges of both
    grid = written(work.groupBy(*k, "bx", "by").agg(F.sum("c").alias("n"), F.sum(pairs_of(F.col("c"), exact).cast("decimal(38,0)")).alias("both")))
    every = joined(grid.select(*k, "bx").distinct(), grid.select(*k, "by").distinct())
    every = every.join(marked(grid.select(*k, "bx", "by", "n"), [*k, "bx", "by"]), on([*k, "bx", "by"]), "left").select(*k, "bx", "by", F.coalesce("n", F.lit(0)).alias("n"))
    before = lambda group, order: Window.partitionBy(*k, group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lower = every.withColumn("s", F.coalesce(F.sum("n").over(before("bx", "by")), F.lit(0))).withColumn("s", F.coalesce(F.sum("s").over(before("by", "bx")), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    apart = lower.where("n > 0").select(*k, (wide("n") * wide("s")).cast("decimal(38,0)").alias("met"), zero.alias("tied_rx"), zero.alias("tied_ry"))
    alone = lambda side: grid.where(F.col(f"b{side}") % 2 == 1).groupBy(*k, f"b{side}").agg(F.sum("n").alias("n")).select(*k, zero.alias("met"), pairs_of(F.col("n"), True).cast("decimal(38,0)").alias(f"tied_r{side}"))
    parts = [apart, within("x", "rx").withColumnRenamed("tied", "tied_rx"), within("y", "bx").withColumnRenamed("tied", "tied_ry"), alone("x"), alone("y")]
    parts = [p.select(*k, "met", *[(F.col(c) if c in p.columns else zero).alias(c) for c in ("tied_rx", "tied_ry")]) for p in parts]
    sums = reduce(DataFrame.unionByName, parts).groupBy(*k).agg(total("met").alias("concordant"), total("tied_rx").alias("tied_rx"), total("tied_ry").alias("tied_ry"))
    both = grid.groupBy(*k).agg(total("both").alias("tied_both"), F.sum("n").alias("n"))
    out = joined(both, sums)
    only = {f"tied_{s}_only": (F.col(f"tied_r{s}") - F.col("tied_both")).cast("decimal(38,0)") for s in "xy"}
    rest = pairs_of(F.col("n"), True).cast("decimal(38,0)") - F.col("concordant") - F.col("tied_rx") - F.col("tied_ry") + F.col("tied_both")
    out = out.withColumns(only | {"discordant": rest.cast("decimal(38,0)")})
    c, d = F.col("concordant").cast("double"), F.col("discordant").cast("double")
    norm = F.sqrt((c + d + F.col("tied_x_only").cast("double")) * (c + d + F.col("tied_y_only").cast("double")))
    return out.select(*k, "n", "tied_both", "tied_x_only", "concordant", "discordant", "tied_y_only", F.try_divide(c - d, norm).alias("tau"))


def shuffled(df: DataFrame, id_col: str, seed: int = 123, order: Column | None = None, name: str = "position") -> DataFrame:
    """Adds a 0-based position in an order that follows from the ids and the seed alone,
    or in that of a given numeric column; ties by id."""
    key = order if order is not None else F.xxhash64(F.col(id_col), F.lit(seed))
    return with_rank(df.withColumn("__o", key), "__o", name, (), "ordinal", id_col).withColumn(name, F.col(name) - 1).drop("__o")


def seeded_order(df: DataFrame, id_col: str, seed: int = 123) -> DataFrame:
    """Rows in an order that follows from their ids and the seed alone."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def split_rows(df: DataFrame, order: str, id_col: str, train: float | int, val: float | int, test: float | int) -> DataFrame:
    """Adds `part` (train, val, test or null) by position in the given order: the first
    rows train, the last test, those before them validate. Ratios below 1 are shares,
    whole numbers are counts; a test size of 0 leaves validation as it is."""
    n = df.count()
    number = lambda s: int(s * n) if isinstance(s, float) else s
    a, b, c = number(train), number(val), number(test)
    if a + b + c > n:
        raise ValueError("the parts are larger than the table")
    ranked = with_rank(df, order, "__p", (), "ordinal", id_col)
    p = F.col("__p")
    return ranked.withColumn("part", F.when(p <= a, "train").when(p > n - c, "test").when(p > n - c - b, "val")).drop("__p")
