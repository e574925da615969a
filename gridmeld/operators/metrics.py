"""Agreement of predictions with a truth, per group of keys.

Pairs are rows with an id, a truth and a prediction. Non-finite pairs don't count.
Every measure with a zero denominator is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmeld.functions.expressions import error_gain, finite
from gridmeld.operators.ranking import curve_of, kendall_of, range_cuts, ranged, with_ranks
from gridmeld.sources.scratch import written


def mask_finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(finite(*[F.col(c) for c in columns]))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate, null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def moments(truth: str = "truth", pred: str = "pred") -> list[Column]:
    """n, r2 (1 - SSres / SStot), mae, rmse and pearson as aggregates."""
    t, p = F.col(truth), F.col(pred)
    return [
        F.count("*").alias("n"),
        (1 - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count("*"))).alias("r2"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        pearson(t, p).alias("pearson"),
    ]


def basic_report(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row of moments per group."""
    return mask_finite(pairs, "truth", "pred").groupBy(*keys).agg(*moments())


def ranked_pairs(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The finite pairs with all their ranks, as a written table from which every measure
    comes: ta, pa (average), to, po (ordinal by id), rt, rp (ordinal,
    best first) and the group's size n."""
    k = list(keys)
    slim = written(mask_finite(pairs, "truth", "pred").select(*k, "id", "truth", "pred"))
    *cuts, _ = range_cuts(slim, ["truth", "pred", "id"])
    names = lambda c: {f"{c}a": ("average", False), f"{c}o": ("ordinal", False), f"r{c}": ("ordinal", True)}
    out = with_ranks(slim, "truth", {**names("t"), "n": ("size", False)}, k, cuts=(cuts[0], cuts[2]))
    return written(with_ranks(out, "pred", names("p"), k, cuts=(cuts[1], cuts[2])))


def spearman(pairs: DataFrame, keys: Sequence[str] = (), method: str = "average") -> DataFrame:
    """(keys, spearman): Pearson of the ranks; `ordinal` ranks ties in order of id."""
    slim, k = written(pairs.select(*keys, "id", "truth", "pred")), list(keys)
    *cuts, _ = range_cuts(slim, ["truth", "pred", "id"])
    ranked = with_ranks(slim, "truth", {"rt": (method, False)}, k, cuts=(cuts[0], cuts[2]))
    ranked = with_ranks(ranked, "pred", {"rp": (method, False)}, k, cuts=(cuts[1], cuts[2]))
    return ranked.groupBy(*k).agg(pearson(F.col("rt").cast("double"), F.col("rp").cast("double")).alias("spearman"))


def report_of(ranked: DataFrame, keys: Sequence[str] = ("model",), shares: Sequence[float] = (0.05, 0.1, 0.2), method: str = "average") -> DataFrame:
    """evaluate() of a table of ranked_pairs()."""
    k, sign = list(keys), "a" if method == "average" else "o"
    least = lambda s: F.greatest(F.lit(1), F.ceil(F.lit(float(s)) * F.col("n")))
    tops = []
    for s in shares:
        overlap = F.count_if(F.greatest("rt", "rp") <= least(s))
        tops += [overlap.alias(f"top{round(s * 100)}_overlap"), (overlap / F.max(least(s))).alias(f"top{round(s * 100)}_recall")]
    main = ranked.groupBy(*k).agg(*moments(), pearson(F.col(f"t{sign}").cast("double"), F.col(f"p{sign}").cast("double")).alias("spearman"), *tops)
    cells = ranked.groupBy(*k, F.col("truth").alias("rx"), F.col("pred").alias("ry")).agg(F.count("*").alias("c"))
    tau = kendall_of(cells, k).select(*[F.col(c).alias(f"__k_{c}") for c in k], "concordant", "discordant", "tau")
    on = F.lit(True)
    for c in k:
        on &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return main.join(tau, on).drop(*[f"__k_{c}" for c in k])


def evaluate(pairs: DataFrame, keys: Sequence[str] = ("model",), shares: Sequence[float] = (0.05, 0.1, 0.2), method: str = "average") -> DataFrame:
    """The full report per group: moments, spearman, kendall's tau-b and, for each
    share, the top-k overlap and recall (top5_overlap, top5_recall, ...)."""
    return report_of(ranked_pairs(pairs, keys), keys, shares, method)


def evaluation(wide: DataFrame, truth: str, preds: dict[str, str], shares: Sequence[float] = (0.05, 0.1, 0.2), curve: Sequence[float] = (), gridsize: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole job for rows (id, truth, one column per model): all columns scaled by their
    common range, then the report, the top-k recall curve and the hexagonal counts of
    both ranks per model. The ranks are worked out once."""
    scaled = joint_min_max(mask_finite(wide, truth, *preds.values()), [truth, *preds.values()])
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{c}_scaled").alias("pred")) for m, c in preds.items()])
    ranked = ranked_pairs(scaled.select("id", F.col(f"{truth}_scaled").alias("truth"), F.inline(models)), ["model"])
    return report_of(ranked, ["model"], shares), curve_of(ranked, curve or shares, ["model"]), hex_bins(ranked.select("model", F.col("to") - 1, F.col("po") - 1, "n").toDF("model", "a", "b", "n"), "a", "b", 0.0, F.col("n"), gridsize, ["model"])


def melted(report: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, metric, value), one row per measure."""
    names = [c for c in report.columns if c not in keys]
    return report.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in names], "metric", "value")


def pivoted(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row per metric and a column per model."""
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def pair_check(left: DataFrame, right: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """(n_left, n_right, unmatched_left, unmatched_right, is_empty), or an error when strict
    and the sides don't hold the same ids."""
    a, b = left.select(F.col(key), F.lit(1).alias("a")), right.select(F.col(key), F.lit(1).alias("b"))
    out = a.join(b, key, "full_outer").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"),
        F.coalesce(F.sum((F.col("b").isNull()).cast("long")), F.lit(0)).alias("unmatched_left"),
        F.coalesce(F.sum((F.col("a").isNull()).cast("long")), F.lit(0)).alias("unmatched_right"),
    ).withColumn("is_empty", F.col("n_left") == 0)
    if strict:
        r = out.first()
        if r["is_empty"] or r["unmatched_left"] or r["unmatched_right"]:
            raise ValueError(f"the sides don't match: {r.asDict()}")
    return out


def quantiles(df: DataFrame, x: str, shares: Sequence[float], keys: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """(keys, quantiles): exact, linearly interpolated quantiles as an array per group. The
    few values at the wanted places are picked by their rank, so no group is gathered."""
    k = list(keys)
    ranked = with_ranks(df, x, {"__p": ("ordinal", False), "__n": ("size", False)}, k, tie or x)
    place = lambda s: F.lit(float(s)) * (F.col("__n") - 1)
    wanted = F.array(*[f(place(s)).cast("long") for s in shares for f in (F.floor, F.ceil)])
    picked = ranked.where(F.array_contains(wanted, F.col("__p") - 1)).groupBy(*k, "__n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("__p") - 1, F.col(x)))).alias("__at"))
    at = lambda c: F.element_at("__at", c.cast("long"))
    value = lambda s: at(F.floor(place(s))) + (at(F.ceil(place(s))) - at(F.floor(place(s)))) * (place(s) - F.floor(place(s)))
    return picked.select(*k, F.array(*[value(s) for s in shares]).alias("quantiles"))


def bin_trend(df: DataFrame, x: str, y: str, bins: int = 10, least: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, low, high, n, x_mean, y_mean, half_width): y over quantile bins of x.

    Equal edges fall together, the last bin holds its upper edge, and bins of fewer
    than `least` rows are left out; half_width is 1.96 standard errors.
    """
    ok, k = written(mask_finite(df, x, y).select(*keys, x, y)), list(keys)
    edges = quantiles(ok, x, [i / bins for i in range(bins + 1)], k, y).select(*[F.col(c).alias(f"__k_{c}") for c in k], F.array_distinct("quantiles").alias("edges"))
    on = F.lit(True)
    for c in k:
        on &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    at = ok.join(edges, on) if k else ok.crossJoin(F.broadcast(edges))  # one row
    at = at.withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= F.col(x))), F.size("edges") - 1) - 1)
    out = at.where("bin >= 0").groupBy(*k, "bin", F.expr("edges[bin]").alias("low"), F.expr("edges[bin + 1]").alias("high"))
    out = out.agg(F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), (F.lit(1.96) * F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("half_width"))
    return out.where(F.col("n") >= least)


def error_gain_trend(df: DataFrame, truth: str, first: str, second: str, covariate: str, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """How the second model's gain over the first goes with the distance from the
    largest covariate: its Spearman correlation, and its trend in bins."""
    ok = written(mask_finite(df, truth, first, second, covariate).select("id", truth, first, second, *[covariate] * (covariate not in (truth, first, second))))
    top = ok.agg(F.max(covariate).alias("__top"))
    rows = ok.crossJoin(F.broadcast(top)).select("id", (F.col("__top") - F.col(covariate)).alias("truth"), error_gain(F.col(truth), F.col(first), F.col(second)).alias("pred"))
    return spearman(rows), bin_trend(rows, "truth", "pred", bins)


def hex_bins(df: DataFrame, x: str, y: str, low: float | Column, high: float | Column, gridsize: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lattice, i, j, n): counts in hexagons over a square extent.

    A hexagonal tiling is two shifted rectangular lattices; a point belongs to the
    nearer of its two lattice points, y counting three times.
    """
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    ny = int(gridsize / 3**0.5)
    sx, sy = (high - low) / gridsize, (high - low) / ny
    u, v = (F.col(x) - low) / sx, (F.col(y) - low) / sy
    i1, j1, i2, j2 = F.bround(u, 0), F.bround(v, 0), F.floor(u), F.floor(v)
    d1 = F.pow(u - i1, 2) + 3 * F.pow(v - j1, 2)
    d2 = F.pow(u - i2 - 0.5, 2) + 3 * F.pow(v - j2 - 0.5, 2)
    near = d1 < d2
    out = df.select(*keys, F.when(near, 0).otherwise(1).alias("lattice"), F.when(near, i1).otherwise(i2).cast("int").alias("i"), F.when(near, j1).otherwise(j2).cast("int").alias("j"))
    return out.groupBy(*keys, "lattice", "i", "j").agg(F.count("*").alias("n"))


def same_keys(keys: Sequence[str], prefix: str = "__k_") -> Column:
    """The condition that a row's keys equal those of another table under a prefix, nulls too."""
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def with_group(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Adds aggregates of each row's group, which are joined, so that a large group isn't one task's."""
    found = df.groupBy(*keys).agg(*aggregates)
    if not keys:
        return df.crossJoin(F.broadcast(found))  # one row
    return df.join(found.withColumnsRenamed({c: f"__k_{c}" for c in keys}), same_keys(keys)).drop(*[f"__k_{c}" for c in keys])


def min_max(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "scaled", flat: str = "raw") -> DataFrame:
    """Scales to 0..1 per group; where a group is flat the value stays (`raw`) or is null."""
    work = with_group(df, keys, F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    if flat == "raw":
        scaled = F.coalesce(scaled, F.col(value))
    return work.withColumn(name, scaled).drop("__lo", "__hi")


def joint_min_max(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Scales several columns by their common least and greatest value (suffix _scaled)."""
    lo, hi = F.least(*[F.min(c) for c in columns]), F.greatest(*[F.max(c) for c in columns])
    work = with_group(df, keys, lo.alias("__lo"), hi.alias("__hi"))
    return work.withColumns({f"{c}_scaled": F.coalesce(F.try_divide(F.col(c) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.col(c)) for c in columns}).drop("__lo", "__hi")


def normaliser(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean, std) with the sample standard deviation, null for one row."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, accepted: str, name: str = "carried", buckets: int | None = None) -> DataFrame:
    """The last accepted value that isn't null, up to each row of a trajectory in the given order (nulls first).

    "Last accepted" is associative, so trajectories are cut into ranges of the first order column,
    which must be a number or a time (ties: by the second, if that is one): it is worked out
    within each (keys, range), then over the ranges' last values, and a row without any in
    its range takes the one before. So a long trajectory is many tasks' work. df is
    read three times, so an expensive one should be a written table.
    """
    k, rows = list(keys), lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    times, types = ("timestamp", "timestamp_ntz", "date"), dict(df.dtypes)
    number = [(F.col(c).cast("timestamp") if types[c] in times else F.col(c)).cast("double").alias(f"__o{i}") for i, c in enumerate(order[:2]) if i == 0 or types[c] not in ("string", "binary")]
    own = F.when(F.col(accepted) & F.col(value).isNotNull(), F.struct(F.col(value).alias("v")))
    work = df.select("*", *number).withColumn("__v", own)
    names = [f"__o{i}" for i in range(len(number))]
    *cuts, _ = range_cuts(work, names, buckets)
    work = ranged(work, "__o0", names[-1], cuts[0], cuts[1] if len(cuts) > 1 else [], nulls_first=True)
    part = [*k, "__b", "__s"]
    work = work.withColumn("__own", F.last("__v", ignorenulls=True).over(rows(Window.partitionBy(*part).orderBy(*order), Window.currentRow)))
    last = F.max_by("__v", F.struct(*order)).alias("__v")
    ends = work.where("__v is not null").groupBy(*part).agg(last)
    ranges = work.select(*part).distinct().withColumnsRenamed({c: f"__k_{c}" for c in part})
    ends = ranges.join(ends, same_keys(part), "left").select(*[f"__k_{c}" for c in part], "__v")
    of_key = Window.partitionBy(*[f"__k_{c}" for c in k]).orderBy("__k___b", "__k___s")  # one row per range
    ends = ends.withColumn("__before", F.last("__v", ignorenulls=True).over(rows(of_key, -1))).drop("__v")
    return work.join(ends, same_keys(part)).withColumn(name, F.coalesce("__own", "__before")["v"]).select(*[c for c in df.columns if c != name], name)
