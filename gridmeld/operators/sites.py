"""Sites, neighbours and graphs: radius joins, zones, linear scores and pooling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmeld.functions.expressions import BOLTZMANN_J, PLANCK_J, TEMPERATURE, apportion, log_rate, radial_basis, sigmoid, softplus
from gridmeld.operators.ranking import sum_before
from gridmeld.sources.scratch import written


#: Images of sites that one task takes of a bin; fuller bins are dealt to several.
PER_BIN = 5_000
#: Rows of sites and their species that one task counts.
PER_PART = 200_000


def _cross(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: Sequence[Column], v: Sequence[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _completed(period: Sequence[Sequence[float]]) -> list[Sequence[float]]:
    """One or two vectors with unit vectors at right angles to all before, three in all."""
    out = [list(map(float, v)) for v in period]
    for axis in ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]) * 2:
        if len(out) == 3:
            break
        if len(out) == 2:
            rest = _cross(*out)
        else:
            u = out[0]
            share = _dot(axis, u) / _dot(u, u)
            rest = [x - share * y for x, y in zip(axis, u)]
        size = _dot(rest, rest) ** 0.5
        if size > 1e-3 or len(out) == 2:
            out.append([x / size for x in rest])
    return out


def _duals(v: Sequence[Sequence[Column]]) -> list[list[Column]]:
    volume = _dot(v[0], _cross(v[1], v[2]))
    return [[c / volume for c in _cross(v[(i + 1) % 3], v[(i + 2) % 3])] for i in range(3)]


class Cell:
    """Lattice vectors, the same for all graphs or those in a column, and their duals.

    The coordinate of a point along vector i, in units of the vector, is its product with
    dual i, and planes of equal coordinates 0 and 1 are 1 / |dual i| apart: the height.
    """

    def __init__(self, period: Sequence[Sequence[float]] | str, periodic: Sequence[bool]) -> None:
        self.column = period if isinstance(period, str) else None
        if self.column:
            at = lambda name: [[F.get(F.get(name, F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]
            self.vectors, self.duals = at(self.column), at("__duals")
            self.along = [i for i in range(3) if periodic[i]]
        else:
            self.vectors = _completed(period)
            self.duals = _duals(self.vectors)
            self.along = list(range(len(period)))

    def wrapped(self, df: DataFrame) -> DataFrame:
        """The points moved into the cell along its periodic vectors, with their coordinates __f0 ... there."""
        at = [F.col(c) for c in "xyz"]
        if self.column:
            # in a lambda, so that the code of one stage stays small
            each = lambda c: F.array(*[F.array(*d) for d in _duals([[F.get(F.get(c, F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)])])
            df = df.withColumn("__duals", F.get(F.transform(F.array(self.column), each), F.lit(0)))
        df = df.withColumns({f"__f{i}": _dot(at, self.duals[i]) for i in self.along})
        moved = {c: sum((-F.floor(f"__f{i}") * self.vectors[i][j] for i in self.along), F.col(c)) for j, c in enumerate("xyz")}
        return df.withColumns(moved | {f"__f{i}": F.col(f"__f{i}") - F.floor(f"__f{i}") for i in self.along})

    def images(self, df: DataFrame, radius: float) -> DataFrame:
        """Of wrapped points all images within the radius of the cell's faces, and `home` for the points themselves."""
        home = F.lit(True)
        for i in self.along:
            reach = radius * F.sqrt(_dot(self.duals[i], self.duals[i]) * F.lit(1.0)) + 1e-9
            df = df.withColumn(f"__n{i}", F.explode(F.sequence(F.ceil(-reach - F.col(f"__f{i}")), F.floor(1 + reach - F.col(f"__f{i}")))))
            home &= F.col(f"__n{i}") == 0
        moved = {c: sum((F.col(f"__n{i}") * self.vectors[i][j] for i in self.along), F.col(c)) for j, c in enumerate("xyz")}
        return df.withColumns(moved | {"home": home})


def _placed(sites: DataFrame, key: str, node: str, period: Sequence[Sequence[float]] | str, periodic: Sequence[bool]) -> tuple[DataFrame, Cell | None]:
    columns = [key, node, *[F.col(c).cast("double").alias(c) for c in "xyz"]]
    if not period:
        return sites.select(*columns), None
    cell = Cell(period, periodic)
    return cell.wrapped(sites.select(*columns, *[period] * isinstance(period, str))), cell


def _bins(radius: float) -> dict[str, Column]:
    return {f"b{c}": F.floor(F.col(c) / radius).cast("long") for c in "xyz"}


def neighbours(sites: DataFrame, radius: float, key: str = "graph", node: str = "node", period: Sequence[Sequence[float]] | str = (), of: DataFrame | None = None, periodic: Sequence[bool] = (True, True, True)) -> DataFrame:
    """(key, node, nbr, dist): all pairs of sites of one graph within a radius, or those
    of the sites `of` with all.

    `period` holds up to three lattice vectors, or names a column of three such vectors of each
    graph, of which `periodic` tells those that repeat. Sites are moved into the cell and have
    as many images as the radius reaches, however small the cell; an image of the site
    itself counts, the site doesn't, and a neighbour seen in several images has a row for each.

    Sites and images are binned by the radius and meet only those of the 27 bins around them, in an equal
    join; bins with more than `PER_BIN` images are dealt to several tasks, with the sites around them repeated.
    """
    base, cell = _placed(sites, key, node, period, periodic)
    images = (cell.images(base, radius) if cell else base.withColumn("home", F.lit(True))).select(key, F.col(node).alias("nbr"), *[F.col(c) for c in "xyz"], "home").withColumns(_bins(radius))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    probe = base if of is None else _placed(of, key, node, period, periodic)[0]
    probe = probe.select(key, node, "x", "y", "z").withColumns(_bins(radius)).withColumn("o", F.explode(around))
    probe = probe.select(key, node, "x", "y", "z", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), (F.col("bz") + F.col("o.k")).alias("bz"))
    bin_ = [key, "bx", "by", "bz"]
    full = images.groupBy(*bin_).agg(F.count("*").alias("__c")).where(F.col("__c") > PER_BIN).select(*bin_, F.ceil(F.col("__c") / PER_BIN).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    images = images.join(full, bin_, "left").withColumn("__part", F.pmod(F.xxhash64("nbr", "x", "y", "z"), parts).cast("int"))
    images = images.select(F.col(key).alias("k2"), "nbr", *[F.col(c).alias(f"{c}2") for c in "xyz"], "home", *[F.col(c).alias(f"{c}2") for c in (*bin_[1:], "__part")])
    probe = probe.join(full, bin_, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    on = (F.col(key) == F.col("k2")) & (F.col("__part") == F.col("__part2"))
    for c in bin_[1:]:
        on &= F.col(c) == F.col(f"{c}2")
    d = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2) + F.pow(F.col("z2") - F.col("z"), 2))
    return probe.join(images, on).where(~(F.col("home") & (F.col(node) == F.col("nbr")))).select(key, node, "nbr", d.alias("dist")).where(F.col("dist") <= radius)


def nearest_within(sites: DataFrame, radius: float, most: int, key: str = "graph", node: str = "node", period: Sequence[Sequence[float]] | str = (), periodic: Sequence[bool] = (True, True, True)) -> DataFrame:
    """(key, node, nbr, dist): the `most` nearest sites of each within a radius, ties to the
    smaller nbr, without the pairs of all within it; periodic as in neighbours(), where each image is a site.

    The search begins with a radius that fits the sites' density and doubles it for the
    sites that haven't met enough others; who has, has met its nearest. Sites that
    share one point meet each other in any case.
    """
    base, cell = _placed(sites, key, node, period, periodic)
    bins = (cell.images(base, radius) if cell else base).groupBy(key, *[b.alias(f"__{c}") for c, b in _bins(radius).items()]).agg(F.count("*").cast("double").alias("c"))
    full = bins.agg(F.try_divide(F.sum(F.col("c") * F.col("c")), F.sum("c"))).first()[0] or 0.0
    steps = min(20, max(0, ceil(log2(max(full / (4 * most), 1.0)) / 3)))
    order = Window.partitionBy(key, node).orderBy("dist", "nbr")
    rest, found = sites.select(key, node, "x", "y", "z", *[period] * isinstance(period, str)), []
    for step in range(steps, -1, -1):
        near = neighbours(sites, radius / 2**step, key, node, period, rest, periodic).withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most)
        if not step:
            found.append(near.drop("__place"))
            break
        near = written(near)
        done = near.where(F.col("__place") == most).select(key, node)
        found.append(near.join(done, [key, node], "left_semi").drop("__place"))
        rest = rest.join(done, [key, node], "left_anti")
    return reduce(DataFrame.unionByName, found)


def nearest_padded(edges: DataFrame, nodes: DataFrame, most: int, pad_distance: float, key: str = "graph", node: str = "node") -> DataFrame:
    """Exactly `most` neighbours per node in order of distance, short lists padded with
    neighbour 0 at the pad distance (is_pad tells them): (key, node, place, nbr, dist, is_pad)."""
    order = Window.partitionBy(key, node).orderBy("dist", "nbr")
    ranked = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    places = nodes.select(key, node).withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(most))))
    out = places.join(ranked, [key, node, "place"], "left")
    return out.select(key, node, "place", F.coalesce("nbr", F.lit(0)).alias("nbr"), F.coalesce("dist", F.lit(float(pad_distance))).alias("dist"), F.col("nbr").isNull().alias("is_pad"))


def bond_features(edges: DataFrame, **options: float) -> DataFrame:
    """Adds bond: the radial basis of each edge's distance."""
    return edges.withColumn("bond", radial_basis(F.col("dist"), **options))


def species_features(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """The nodes with their species' feature array; unknown species have none."""
    return nodes.join(table, "species")


def missing_species(nodes: DataFrame, table: DataFrame) -> DataFrame:
    return nodes.join(table, "species", "left_anti").select("species").distinct()


def species_of(features: DataFrame, table: DataFrame) -> DataFrame:
    """Finds the species whose feature array a row holds."""
    return features.join(table, "features")


def layers(sites: DataFrame, size: int, key: str = "config", node: str = "site") -> DataFrame:
    """Adds layer: sites from the top down in chunks of a layer's size, from 0."""
    order = Window.partitionBy(key).orderBy(F.desc("z"), node)
    return sites.withColumn("layer", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def zones(edges: DataFrame, tagged: DataFrame) -> DataFrame:
    """(node, nbr, zone) of the top layer's sites: zone 1 is the site itself, 2 its
    neighbours in its layer, 3 those in the next."""
    top = tagged.where("layer = 0").select(F.col("site").alias("node"))
    tag = tagged.select(F.col("site").alias("nbr"), "layer")
    near = edges.join(top, "node").join(tag, "nbr").where("layer <= 1").select("node", "nbr", (F.col("layer") + 2).alias("zone"))
    return top.select("node", F.col("node").alias("nbr"), F.lit(1).alias("zone")).unionByName(near)


def zone_counts(zoned: DataFrame, species: DataFrame, kinds: Sequence[int], key: str = "config") -> DataFrame:
    """(key, node, z<zone>_<kind>): neighbours of each kind in each zone, per site.

    The zones are those of one stated, small set of sites. Only sites in a zone are kept, and dealt
    by key to partitions of about `PER_PART` rows, so that a task holds as many counts however many keys there are.
    """
    zoned = F.broadcast(zoned)
    near = F.broadcast(zoned.select("nbr").distinct())
    slim = written(species.select(key, F.col("site").alias("nbr"), "species").join(near, "nbr", "left_semi").select(key, "nbr", "species"))
    parts = max(species.sparkSession.sparkContext.defaultParallelism, slim.count() // PER_PART + 1)
    each = slim.repartition(parts, key).join(zoned, "nbr")
    return each.groupBy(key, "node").agg(*[F.sum(((F.col("zone") == z) & (F.col("species") == s)).cast("int")).alias(f"z{z}_{s}") for z in (1, 2, 3) for s in kinds])


def linear_score(counts: DataFrame, coefficients: dict[str, float], name: str = "energy") -> DataFrame:
    total = F.lit(0.0)
    for column, weight in coefficients.items():
        total = total + F.lit(float(weight)) * F.col(column)
    return counts.withColumn(name, total)


def boltzmann(scored: DataFrame, key: str = "config", energy: str = "energy") -> DataFrame:
    """(key, n, activity): ln of the mean rate. The largest log rate is taken out
    first, so that no term overflows or vanishes."""
    rate = scored.withColumn("l", log_rate(F.col(energy)))
    top = rate.groupBy(F.col(key).alias("__k")).agg(F.max("l").alias("top"))
    sums = rate.join(top, F.col(key).eqNullSafe(F.col("__k"))).groupBy(key).agg(F.max("top").alias("top"), F.count("*").alias("n"), F.avg(F.exp(F.col("l") - F.col("top"))).alias("m"))
    return sums.select(key, "n", (F.col("top") + F.log("m")).alias("activity"))


def global_ids(nodes: DataFrame, key: str = "graph", node: str = "node") -> DataFrame:
    """Adds global_id: the local id plus the nodes of all graphs before. Only the
    graphs' sizes are summed in order, in ranges of the key, which must be numeric."""
    sizes = written(nodes.groupBy(key).agg(F.count("*").alias("__n")))
    base = sum_before(sizes, key, "__n", "__base").drop("__n")
    return nodes.join(base, key).withColumn("global_id", F.col(node) + F.col("__base")).drop("__base")


def graph_features(points: DataFrame, radius: float, most: int, pad_distance: float, key: str = "graph", period: Sequence[Sequence[float]] | str = (), periodic: Sequence[bool] = (True, True, True), **bond: float) -> DataFrame:
    """The whole job from nodes (key, node, x, y, z, features) to a graph's tensors as rows:
    per node exactly `most` neighbours in order of distance, short lists padded, each
    with its bond filters, both ends' features (null for padding) and both ends' ids
    over all graphs: (key, node, place, nbr, dist, is_pad, bond, global_id, nbr_global_id,
    features, nbr_features). Local ids must run from 0 within each graph. With `period` and
    `periodic` as in neighbours(), the graphs are crystals or slabs and images are neighbours."""
    rows = bond_features(nearest_padded(nearest_within(points, radius, most, key, "node", period, periodic), points, most, pad_distance, key), **bond)
    known = written(global_ids(points, key).select(key, "node", "global_id", "features"))
    other = known.select(key, F.col("node").alias("nbr"), (F.col("global_id") - F.col("node")).alias("__start"), F.col("features").alias("nbr_features"))
    out = rows.join(known, [key, "node"]).join(other, [key, "nbr"], "left")
    return out.select(
        key, "node", "place", "nbr", "dist", "is_pad", "bond", "global_id", (F.col("global_id") - F.col("node") + F.col("nbr")).alias("nbr_global_id"), "features",
        F.when(~F.col("is_pad"), F.col("nbr_features")).alias("nbr_features"),
    )


def sites_of(compositions: DataFrame, elements: Sequence[str], sites: DataFrame, order: Column, key: str = "config") -> DataFrame:
    """(key, site, species): each composition's whole parts dealt to the sites in the given
    order (ties by site); species is the element's place in the list, what rounding
    leaves goes to the last. The sites (site) are a stated, small set."""
    n = sites.count()
    counts = apportion([F.col(e) for e in elements], n)
    ends, total = [], F.lit(0)
    for c in counts:
        total = total + c
        ends.append(total)
    each = compositions.select(key, F.array(*ends).alias("__ends")).crossJoin(F.broadcast(sites.select("site")))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, "site"))
    return each.withColumn("__p", place).select(key, "site", F.size(F.filter("__ends", lambda e: e < F.col("__p"))).alias("species")).where(F.col("species") < len(elements))


def score_compositions(compositions: DataFrame, elements: Sequence[str], sites: DataFrame, edges: DataFrame, layer_size: int, coefficients: dict[str, float], order: Column, key: str = "config") -> DataFrame:
    """The whole job from a table of compositions to their activities: sites filled,
    neighbours of the top layer counted by zone, a linear score per site, and the
    Boltzmann average. The geometry (sites with z, and edges) is one for all."""
    tagged = layers(sites.select(F.lit(0).alias("config"), "site", "z"), layer_size).select("site", "layer")
    filled = sites_of(compositions, elements, sites, order, key)
    counts = zone_counts(zones(edges, tagged), filled, range(len(elements)), key)
    return boltzmann(linear_score(counts, coefficients), key)


def gather(edges: DataFrame, nodes: DataFrame, key: str = "graph") -> DataFrame:
    """Each edge with the features of both its ends joined to one array."""
    own = nodes.select(key, F.col("node"), F.col("features").alias("__own"))
    other = nodes.select(key, F.col("node").alias("nbr"), F.col("features").alias("__other"))
    return edges.join(own, [key, "node"]).join(other, [key, "nbr"]).withColumn("features", F.concat("__own", "__other")).drop("__own", "__other")


def gated_sum(edges: DataFrame, gate: Column, core: Column, key: str = "graph") -> DataFrame:
    """(key, node, message): the sum of sigmoid(gate) * softplus(core) over edges."""
    return edges.groupBy(key, "node").agg(F.sum(sigmoid(gate) * softplus(core)).alias("message"))


def mean_pool(nodes: DataFrame, width: int, key: str = "graph", features: str = "features") -> DataFrame:
    """(key, n, pooled): the mean feature array of each graph's nodes."""
    means = [F.avg(F.get(features, F.lit(i))) for i in range(width)]
    return nodes.groupBy(key).agg(F.count("*").alias("n"), F.array(*means).alias("pooled"))


#: kT/h at the stated temperature.
PREFACTOR = BOLTZMANN_J * TEMPERATURE / PLANCK_J
