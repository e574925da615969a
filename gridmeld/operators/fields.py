"""Gridded fields as long tables (keys, y, x, value); an absent cell has no row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmeld.functions.expressions import apportion, bucket, edge_list, euclidean, finite, gaussian_2d, log_shift, lut_index
from gridmeld.operators.metrics import min_max
from gridmeld.sources.scratch import written


def full_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All cells (y, x)."""
    n = height * width
    return spark.range(n).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def flatten_index(y: Column, x: Column, width: int) -> Column:
    return y * width + x


def unflatten_index(index: Column, width: int) -> tuple[Column, Column]:
    return F.floor(index / width).cast("int"), F.pmod(index, F.lit(width)).cast("int")


def flip(df: DataFrame, height: int) -> DataFrame:
    """Turns the rows upside down."""
    return df.withColumn("y", F.lit(height - 1) - F.col("y"))


def present(df: DataFrame, value: str = "value", zero_absent: bool = False) -> DataFrame:
    """Only the cells with a finite value (and not zero, if that means absent)."""
    ok = finite(F.col(value))
    return df.where(ok & (F.col(value) != 0) if zero_absent else ok)


def background(df: DataFrame, channels: Sequence[str] = ("r", "g", "b", "a"), bright: float = 0.92, border: int = 49) -> DataFrame:
    """Drops cells that are all bright, all zero, or in the border rows and columns."""
    a = F.array(*channels)
    return df.where(~(F.forall(a, lambda c: c > bright) | F.forall(a, lambda c: c == 0) | (F.col("y") >= border) | (F.col("x") >= border)))


def cut(df: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """A rectangle, with coordinates from 0."""
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return df.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def embed(df: DataFrame, height: int, width: int, dy: int, dx: int, fill: float | None = None, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """A grid of the given size per map with df at an offset; other cells hold fill."""
    k = list(keys)
    moved = df.select(*k, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), value)
    cells = full_grid(df.sparkSession, height, width)
    if k:
        cells = df.select(*k).distinct().crossJoin(F.broadcast(cells))  # the grid's size is a parameter
    out = cells.join(moved, [*k, "y", "x"], "left")
    return out.select(*k, "y", "x", F.coalesce(value, F.lit(fill)).alias(value)) if fill is not None else out


def to_dense(df: DataFrame, height: int, width: int, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """All cells of each map, null where df has none."""
    return embed(df, height, width, 0, 0, None, value, keys)


def masked(df: DataFrame, mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The cells that the mask has, each map's own where the mask has the keys."""
    on = ["y", "x", *[c for c in keys if c in mask.columns]]
    return df.join(mask.select(*on), on, "left_semi")


def offset_errors(raw: DataFrame, target: DataFrame, most_dy: int, most_dx: int, keys: Sequence[str] = (), complete_only: bool = True) -> DataFrame:
    """(keys, dy, dx, n_valid, diff): the mean absolute difference of the target and the
    min-max scaled patch of raw under it, for every offset up to the given ones. The
    target may be one for all maps or have keys itself, and its absent values don't count; with complete_only an offset
    counts only if each cell of its target has a value under it.

    Each target cell meets its raw cell by an equal join per offset; the patch's range
    and the differences are two aggregates over (keys, offset) with partial sums.
    """
    spark, k = raw.sparkSession, list(keys)
    target, own = present(target), [c for c in k if c in target.columns]
    offsets = full_grid(spark, most_dy + 1, most_dx + 1).select(F.col("y").alias("dy"), F.col("x").alias("dx"))
    want = target.crossJoin(F.broadcast(offsets)).select(*own, "dy", "dx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col("value").alias("want"))
    cells = want.join(present(raw).select(*k, "y", "x", "value"), ["y", "x", *own])
    span = cells.groupBy(*k, "dy", "dx").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n_valid"))
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.col("value"))
    out = cells.join(span, [*k, "dy", "dx"]).groupBy(*k, "dy", "dx", "n_valid").agg(F.avg(F.abs(scaled - F.col("want"))).alias("diff"))
    if complete_only:
        sizes = target.groupBy(*own).agg(F.count("*").alias("__n"))
        out = (out.join(sizes, own) if own else out.crossJoin(F.broadcast(sizes))).where("n_valid = __n").drop("__n")
    return out


def best_offset(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The offset of least difference, ties to the first in row order."""
    return errors.groupBy(*keys).agg(F.min(F.struct("diff", "dy", "dx")).alias("b")).select(*keys, "b.dy", "b.dx", "b.diff")


def patch_at(raw: DataFrame, mask: DataFrame, offset: DataFrame, keys: Sequence[str] = (), value: str | None = "value") -> DataFrame:
    """The cells of raw under the mask moved by the offset (one row per map, or one for
    all), with mask coordinates, and their min-max scaled value."""
    own = [c for c in keys if c in raw.columns and c in offset.columns]
    moved = raw.join(offset, own) if own else raw.crossJoin(F.broadcast(offset))  # one row per map
    moved = masked(moved.withColumns({"y": F.col("y") - F.col("dy"), "x": F.col("x") - F.col("dx")}), mask, keys)
    return min_max(moved, value, [c for c in keys if c in moved.columns]) if value else moved


def align_fields(raw: DataFrame, target: DataFrame, followers: dict[str, DataFrame], composition: DataFrame, most_dy: int, most_dx: int, width: int, raw_width: int, keys: Sequence[str] = (), complete_only: bool = True, best: DataFrame | None = None) -> DataFrame:
    """The whole alignment job: the best offset of the target inside raw, per map (or those
    given as `best` (keys, dy, dx), such as `search.find_offset` finds on large grids); at that
    offset the scaled patch of raw (`scaled`) and of each follower (a column of its
    name), and the columns of the composition table, which has keys or is one for all.

    Returns (keys, local_index, global_index, y, x, dy, dx, scaled, followers, composition):
    a row per target cell that raw has a value for.
    """
    k = list(keys)
    best = (best if best is not None else best_offset(offset_errors(raw, target, most_dy, most_dx, k, complete_only), k)).select(*k, "dy", "dx")
    out = patch_at(present(raw), target, best, k).select(*k, "y", "x", "dy", "dx", "scaled")
    for name, df in followers.items():
        other = patch_at(present(df), target, best, k).select(*k, "y", "x", F.col("scaled").alias(name))
        out = out.join(other, [*k, "y", "x"], "left")
    columns = [c for c in composition.columns if c not in ("y", "x", *k)]
    rows = patch_at(composition, target, best, k, None).select(*k, "y", "x", *columns)
    out = out.join(rows, [*k, "y", "x"], "left")
    local, world = flatten_index(F.col("y"), F.col("x"), width), flatten_index(F.col("y") + F.col("dy"), F.col("x") + F.col("dx"), raw_width)
    return out.select(*k, local.alias("local_index"), world.alias("global_index"), "y", "x", "dy", "dx", "scaled", *followers, *columns)


#: A codebook of at most so many codes goes to every row as one array; a larger one is searched by its grid.
SMALL_BOOK = 256
#: Codes that a cell of the grid should hold.
PER_CELL = 1


def nearest_code(df: DataFrame, codes: DataFrame, vector: str, code_vector: str = "code", code_id: str = "idx") -> DataFrame:
    """Adds idx and dist: the nearest codeword, ties (to nine digits) to the smaller idx; null
    where the vector is null or holds null or NaN, or where there is no codeword. All vectors have one length.

    A book of at most `SMALL_BOOK` codes is compared with each row in one expression. A
    larger one is never gathered or broadcast, whatever its size on disk: codes and the distinct
    vectors meet by cells of a grid over the first three components, in a sort-merge join. A vector is done as soon as no code
    outside the cells around it can be nearer; the cells double for those that aren't, so
    vectors far from all codes meet many of them.
    """
    book = codes.where(F.col(code_vector).isNotNull()).groupBy(F.col(code_vector).cast("array<double>").alias("__c")).agg(F.min(code_id).alias("__i"))
    book = written(book)
    n, size = book.agg(F.count("*"), F.max(F.size("__c"))).first()
    sound = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    v = F.col(vector).cast("array<double>")
    if n <= SMALL_BOOK:
        all_codes = book.agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__c").alias("c")))).alias("__book"))
        best = F.array_min(F.transform("__book", lambda e: _distance(euclidean(v, e["c"]), e["i"])))
        return df.crossJoin(F.broadcast(all_codes)).withColumn("__best", F.when(sound(v), best)).drop("__book").withColumns({"idx": F.col("__best.i"), "dist": F.col("__best.d")}).drop("__best")
    vectors = written(df.select(v.alias("__v")).where(sound(F.col("__v"))).distinct().withColumn("__id", F.monotonically_increasing_id()))
    found = _by_grid(vectors, book.where(sound(F.col("__c"))), size).join(vectors.hint("merge"), "__id").select("__v", "idx", "dist")
    kept = [c for c in df.columns if c not in ("idx", "dist")]
    return df.select(*kept, v.alias("__w")).join(found.hint("merge"), F.col("__w") == F.col("__v"), "left").select(*kept, "idx", "dist")


def _distance(d: Column, i: Column) -> Column:
    return F.struct(F.round(d, 9).alias("r"), i.alias("i"), d.alias("d"))


def _by_grid(vectors: DataFrame, book: DataFrame, size: int) -> DataFrame:
    """(__id, idx, dist) of distinct vectors (__id, __v) of a length.

    A vector outside the codes' box is searched from the box's nearest point: codes
    further than w from that point are at least sqrt(out^2 + w^2) away, where out is the
    vector's distance from the box. Components beyond the grid's only add to distances.
    The first cells are met twice, for the least distance as a hash aggregate of plain numbers and for the least code at
    it; later ones once, as only codes no further than those found before are kept.

    All joins are merges: the tables are small on disk, but not in memory. The side with fewer rows is copied to the
    cells around its own, and pairs are dealt to all partitions, as few rows may make many of them.
    """
    dims = min(3, size)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda name, j: F.get(name, F.lit(j))
    ends = book.agg(*[f(part("__c", j)) for f in (F.min, F.max) for j in range(dims)]).first()
    low, high = ends[:dims], ends[dims:]
    span = max(max(h - l for l, h in zip(low, high)), 1e-12)
    at = lambda name, j, w: F.floor((F.least(F.greatest(part(name, j), F.lit(low[j])), F.lit(high[j])) - F.lit(low[j])) / w).cast("long")
    out = sum((F.pow(F.greatest(F.lit(low[j]) - part("__v", j), part("__v", j) - F.lit(high[j]), F.lit(0.0)), 2) for j in range(dims)), F.lit(0.0))
    cells = lambda name, w: {f"__g{j}": at(name, j, w) for j in range(dims)}
    grid = [f"__g{j}" for j in range(dims)]
    if size <= 8:  # the same sum as euclidean(), as plain code
        distance = F.sqrt(sum(((part("__v", j) - part("__c", j)) * (part("__v", j) - part("__c", j)) for j in range(size)), F.lit(0.0)))
    else:
        distance = euclidean(F.col("__v"), F.col("__c"))

    def met(some: DataFrame, w: float, copied: bool) -> DataFrame:
        """The vectors with the codes of the cells around them and their distance; of both the
        vectors are copied to these cells, or else the codes."""
        ours, theirs = some.withColumns(cells("__v", w)), book.withColumns(cells("__c", w))
        for g in grid:
            around = F.explode(F.array(*[F.col(g) + k for k in (-1, 0, 1)]))
            ours, theirs = (ours.withColumn(g, around), theirs) if copied else (ours, theirs.withColumn(g, around))
        return ours.repartition(tasks, *grid).join(theirs.repartition(tasks, *grid).hint("merge"), grid).withColumn("__d", distance)

    n = book.count()
    width = span / max(1.0, (n / PER_CELL) ** (1 / dims))
    full = book.withColumns(cells("__c", width)).groupBy(*grid).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 1.0
    width /= 2 ** min(16, ceil(log2(max(full / PER_CELL, 1.0)) / dims))  # finer where most codes stand close together
    least = met(vectors, width, vectors.count() < n).groupBy("__id").agg(F.min("__d").alias("__least"))
    rest, found = written(vectors.join(least.hint("merge"), "__id", "left")), []
    while True:
        near = met(rest, width, rest.count() < n).where(F.col("__least").isNull() | (F.col("__d") <= F.col("__least") + 1e-8))
        best = near.groupBy("__id").agg(F.min(_distance(F.col("__d"), F.col("__i"))).alias("__best"))
        sure = F.lit(True) if width > span else F.col("__best.d") + 1e-8 <= F.sqrt(out + width * width)  # beyond the span all codes are in the cells around any vector
        level = written(rest.join(best.hint("merge"), "__id", "left").withColumn("__sure", F.coalesce(sure, F.lit(False))))
        found.append(level.where("__sure and __best is not null").select("__id", F.col("__best.i").alias("idx"), F.col("__best.d").alias("dist")))
        rest = level.where("not __sure").select("__id", "__v", F.least("__least", "__best.d").alias("__least"))
        if not rest.head(1):
            return reduce(DataFrame.unionByName, found)
        width *= 2


def tiles_by_table(df: DataFrame, value: str, edges: DataFrame, keys: Sequence[str] = (), name: str = "tile") -> DataFrame:
    """Adds the number (from 0) of the last edge at or below a value, null outside of a map's
    edges, for edges in a table (keys, edge), which may be thousands and differ from map to map.

    The stretches between neighbouring edges are entered in every bucket of a map's mean
    stretch that they touch, twice as many as there are edges at most, and values meet
    them by bucket in an equal join. Equal edges count each, but only the last of them begins a
    stretch; a map's last edge ends its last. Null edges don't count. Where most of a map's edges crowd in a
    small part of it, values there meet all edges of their bucket.
    """
    k = [F.col(c).alias(f"__k_{c}") for c in keys]
    of_map = Window.partitionBy(*[f"__k_{c}" for c in keys]).orderBy("__e")
    known = edges.where(F.col("edge").isNotNull()).select(*k, F.col("edge").cast("double").alias("__e"))
    spans = known.groupBy(*[f"__k_{c}" for c in keys]).agg(F.min("__e").alias("__low"), F.max("__e").alias("__high"), F.count("*").alias("__n"))
    spans = spans.where("__high > __low").withColumn("__w", (F.col("__high") - F.col("__low")) / F.col("__n"))
    bucket_of = lambda c: F.floor((F.col(c) - F.col("__low")) / F.col("__w")).cast("long")
    steps = known.withColumns({"__to": F.lead("__e").over(of_map), "__i": (F.row_number().over(of_map) - 1).cast("int")}).where("__to > __e")
    steps = steps.join(spans.withColumnsRenamed({f"__k_{c}": f"__m_{c}" for c in keys}), _equal([f"__k_{c}" for c in keys], [f"__m_{c}" for c in keys]))
    steps = steps.select(*[f"__k_{c}" for c in keys], "__e", "__to", "__i", F.explode(F.sequence(bucket_of("__e"), bucket_of("__to"))).alias("__b"))
    out = df.join(spans.withColumnsRenamed({f"__k_{c}": f"__m_{c}" for c in keys}), _equal(keys, [f"__m_{c}" for c in keys]), "left").withColumn("__at", bucket_of(value))
    inside = (F.col("__at") == F.col("__b")) & (F.col(value) >= F.col("__e")) & (F.col(value) < F.col("__to"))
    out = out.join(steps, inside & _equal(keys, [f"__k_{c}" for c in keys]), "left")
    return out.select(*[c for c in df.columns if c != name], F.col("__i").alias(name))


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)), F.lit(True))


def tile_means(pixels: DataFrame, tiles_y: int, tiles_x: int, extent_y: tuple[float, float], extent_x: tuple[float, float], channels: Sequence[str], scale: float = 255.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, x, channels): means of the pixels between evenly spaced integer edges.
    The edges follow from the parameters, so they are constants in the plan."""
    at = pixels.withColumns({"__ty": bucket(F.col("y"), edge_list(*extent_y, tiles_y)), "__tx": bucket(F.col("x"), edge_list(*extent_x, tiles_x))}).where("__ty is not null and __tx is not null")
    return at.groupBy(*keys, F.col("__ty").alias("y"), F.col("__tx").alias("x")).agg(*[(F.avg(c) / scale).alias(c) for c in channels])


def activity_field(pixels: DataFrame, palette: DataFrame, tiles_y: int, tiles_x: int, extent_y: tuple[float, float], extent_x: tuple[float, float], channels: Sequence[str] = ("r", "g", "b", "a"), bright: float = 0.92, border: int = 49, keys: Sequence[str] = ()) -> DataFrame:
    """The whole job from pixels to a map: tile means, background dropped, colours turned
    into the values of the nearest palette entry (idx, value, code), ln(v - min + 1),
    scaled to 0..1, upside down, on the dense grid (keys, y, x, value; null: absent)."""
    k = list(keys)
    tiles = background(tile_means(pixels, tiles_y, tiles_x, extent_y, extent_x, channels, keys=k), channels, bright, border)
    found = nearest_code(tiles.withColumn("__c", F.array(*channels)), palette, "__c").select(*k, "y", "x", "idx")
    found = found.join(palette.select("idx", "value"), "idx").select(*k, "y", "x", "value")
    low = found.groupBy(*k).agg(F.min("value").alias("__low"))
    found = (found.join(low, k) if k else found.crossJoin(F.broadcast(low))).withColumn("value", log_shift(F.col("value"), F.col("__low")))
    scaled = min_max(found, "value", k).select(*k, "y", "x", F.col("scaled").alias("value"))
    return to_dense(flip(scaled, tiles_y), tiles_y, tiles_x, keys=k)


#: Up to so many centres of a mixture go to every cell as arrays; more are met within their reach.
SMALL_MIXTURE = 1_000
#: Cells or centres that one part of a bin holds; fuller bins are dealt to several.
PER_BIN = 5_000


def mixture(cells: DataFrame, centres: DataFrame, keys: Sequence[str] = (), error: float = 1e-12) -> DataFrame:
    """(keys, y, x, element, value): the sum of each element's Gaussian bumps at each cell.
    Cells come once each; centres with a null or a width that isn't positive don't count.

    Up to `SMALL_MIXTURE` centres are gathered, an array per element. More are never gathered:
    a bump counts only where it adds more than error / n, n being the centres of the
    largest element, so that sums are too small by less than `error`, and meets the cells there by bins.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    centres = centres.select("element", *map(number, ("mux", "muy", "sigma"))).where("mux is not null and muy is not null and sigma > 0")
    if centres.limit(SMALL_MIXTURE + 1).count() > SMALL_MIXTURE:
        return _mixture_within(cells, written(centres), list(keys), error)
    bumps = centres.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("mux", "muy", "sigma"))).alias("__c"))
    each = cells.crossJoin(F.broadcast(bumps))
    one = lambda c: gaussian_2d(F.col("x"), F.col("y"), c["mux"], c["muy"], c["sigma"])
    return each.select(*keys, "y", "x", "element", F.aggregate("__c", F.lit(0.0), lambda s, c: s + one(c)).alias("value"))


def _mixture_within(cells: DataFrame, centres: DataFrame, keys: list[str], error: float) -> DataFrame:
    """The sums over centres within reach, in an equal join on bins.

    A centre's bins are as wide as the next power of two of its reach, so it has at most
    three a side, and a cell has one bin for each such width, of which there are as many as the
    reaches differ by powers of two. Bins with many cells or many centres are dealt: each part of
    the cells meets each part of the centres in its own group.
    """
    counts = written(centres.groupBy("element").agg(F.count("*").alias("n")))
    elements, most = counts.agg(F.count("*"), F.max("n")).first()
    reach = F.col("sigma") * sqrt(2 * log(max(most / error, 2.0)))
    same = centres.groupBy("element", "mux", "muy", "sigma").agg(F.count("*").alias("__times"))
    bumps = written(same.withColumn("__r", reach).withColumn("__level", F.ceil(F.log2("__r")).cast("int")))
    width = F.pow(F.lit(2.0), F.col("__level"))
    bins = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("__r")) / width), F.floor((F.col(c) + F.col("__r")) / width)))
    left = bumps.withColumn("__by", bins("muy")).withColumn("__bx", bins("mux"))
    levels = bumps.select("__level").distinct()  # at most the exponents of a double
    right = cells.select(*keys, "y", "x").crossJoin(F.broadcast(levels)).withColumns({f"__b{c}": F.floor(F.col(c) / width) for c in "yx"})
    at = ["__level", "__by", "__bx"]
    parts = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / PER_BIN).cast("int").alias(name))
    dealt = written(parts(left, "__nl").join(parts(right, "__nr"), at))  # bins with both
    own = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(dealt, at).withColumn("__pl", own("__nl", "element", "mux", "muy", "sigma")).withColumn("__pr", every("__nr"))
    right = right.join(dealt, at).withColumn("__pr", own("__nr", *keys, "y", "x")).withColumn("__pl", every("__nl"))
    met = right.drop("__nl", "__nr").join(left.drop("__nl", "__nr"), [*at, "__pl", "__pr"])
    met = met.where(F.pow(F.col("x") - F.col("mux"), 2) + F.pow(F.col("y") - F.col("muy"), 2) <= F.pow("__r", 2))
    bump = gaussian_2d(F.col("x"), F.col("y"), F.col("mux"), F.col("muy"), F.col("sigma"))
    sums = met.groupBy(*keys, "y", "x", "element").agg(F.sum(bump * F.col("__times")).alias("__v"))
    named = counts.select("element")
    each = cells.select(*keys, "y", "x").crossJoin(F.broadcast(named) if elements <= SMALL_MIXTURE else named)  # these are the rows asked for
    ours, theirs = [*keys, "y", "x", "element"], [f"__k{i}" for i in range(len(keys) + 3)]
    out = each.join(sums.withColumnsRenamed(dict(zip(ours, theirs))), _equal(ours, theirs), "left")
    return out.select(*ours, F.coalesce("__v", F.lit(0.0)).alias("value"))


def masked_rmse(pairs: DataFrame, centre_y: int, centre_x: int, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE of value against other with one row and one column counted as equal."""
    d = F.when((F.col("y") == centre_y) | (F.col("x") == centre_x), 0.0).otherwise(F.pow(F.col("value") - F.col("other"), 2))
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(d)).alias("rmse"))


def step_lookup(df: DataFrame, lut: DataFrame, value: str, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Replaces a value of 0 to 1 by the step table's entry for it."""
    table = lut.select(*keys, F.col("idx").alias("__i"), F.col("v").alias("__v"))
    return df.withColumn("__i", lut_index(F.col(value))).join(table, [*keys, "__i"]).withColumn(value, F.col("__v")).drop("__i", "__v")


def shares(df: DataFrame, cell: Sequence[str], value: str = "value") -> DataFrame:
    """Adds share: the value over its cell's sum, where a sum of 0 counts as 1."""
    total = F.sum(value).over(Window.partitionBy(*cell))
    return df.withColumn("share", F.col(value) / F.when(total == 0, 1.0).otherwise(total))


def composition(shares_long: DataFrame, elements: Sequence[str], parts: int = 512, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, x, one column per element): whole parts of each share over all parts, the
    last element taking what rounding leaves."""
    wide = shares_long.groupBy(*keys, "y", "x").pivot("element", list(elements)).agg(F.first("share"))
    counts = apportion([F.coalesce(F.col(e), F.lit(0.0)) for e in elements], parts)
    return wide.select(*keys, "y", "x", *[(c / F.lit(float(parts))).alias(e) for e, c in zip(elements, counts)])
