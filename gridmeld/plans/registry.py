"""The registered queries of the field, ranking and scoring operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeld.functions import expressions as E
from gridmeld.operators import fields, metrics, ranking, search, sites
from gridmeld.sources import files
from gridmeld.sources.scratch import scratch_path as _scratch
from gridmeld.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Floating sums depend on their order, so results are compared to some digits; the
    sum with 0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# ---- paired vectors: an order's price against two predictions from its lines ----

_PAIRS = """
    base AS (
        SELECT o_orderkey AS id, o_totalprice AS truth, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS pa,
            CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS pb
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice),
    pairs AS (SELECT 'a' AS model, id, truth, pa AS pred FROM base UNION ALL SELECT 'b', id, truth, pb FROM base)"""


def wide_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.sum(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000)).cast("double") / 10000).alias("pa"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("pb"),
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("truth"))
    return orders.join(lines, F.col("id") == F.col("l_orderkey")).select("id", "truth", "pa", "pb")


def long_pairs(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in (("a", "pa"), ("b", "pb"))])
    return wide_pairs(spark, d).select("id", "truth", F.inline(models)).select("model", "id", "truth", "pred")


_MOMENTS = """
    m AS (
        SELECT model, count(*) AS n, 1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*)) AS r2, avg(abs(truth - pred)) AS mae,
            sqrt(avg((truth - pred) * (truth - pred))) AS rmse, covar_pop(truth, pred) / sqrt(var_pop(truth) * var_pop(pred)) AS pearson
        FROM pairs GROUP BY model),
    rk AS (
        SELECT model, id, rank() OVER (PARTITION BY model ORDER BY truth) + (count(*) OVER (PARTITION BY model, truth) - 1) / 2.0 AS rt,
            rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0 AS rp
        FROM pairs),
    sp AS (SELECT model, covar_pop(rt, rp) / sqrt(var_pop(rt) * var_pop(rp)) AS spearman FROM rk GROUP BY model)"""

_KENDALL = """
    kp AS (
        SELECT x.model, count(*) FILTER (WHERE (x.truth - y.truth) * (x.pred - y.pred) > 0) AS concordant, count(*) FILTER (WHERE (x.truth - y.truth) * (x.pred - y.pred) < 0) AS discordant,
            count(*) FILTER (WHERE x.truth = y.truth AND x.pred <> y.pred) AS tx, count(*) FILTER (WHERE x.truth <> y.truth AND x.pred = y.pred) AS ty,
            count(*) FILTER (WHERE x.truth = y.truth AND x.pred = y.pred) AS txy
        FROM pairs x JOIN pairs y ON x.model = y.model AND x.id < y.id GROUP BY x.model)"""


def _top(shares: tuple[float, ...]) -> str:
    values = ", ".join(f"(CAST({s} AS DOUBLE))" for s in shares)
    return f"""
    ro AS (
        SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY truth DESC, id) AS rt, row_number() OVER (PARTITION BY model ORDER BY pred DESC, id) AS rp FROM pairs),
    ct AS (
        SELECT model, share, greatest(1, CAST(ceil(share * n) AS BIGINT)) AS k FROM (SELECT model, count(*) AS n FROM pairs GROUP BY model), (VALUES {values}) v(share)),
    ov AS (
        SELECT ct.model, share, k, count(*) FILTER (WHERE rt <= k AND rp <= k) AS overlap FROM ct JOIN ro ON ro.model = ct.model GROUP BY ct.model, share, k)"""


_SHARES = (0.05, 0.1, 0.2)


@query(f"""WITH {_PAIRS}, {_MOMENTS}, {_KENDALL}, {_top(_SHARES)}
    SELECT model, n, round(r2, 8) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(pearson, 8) AS pearson, round(spearman, 8) AS spearman, concordant, discordant,
        round((concordant - discordant) / sqrt(CAST(concordant + discordant + tx AS DOUBLE) * (concordant + discordant + ty)), 8) AS tau,
        {", ".join(f"max(overlap) FILTER (WHERE share = {s}) AS top{round(s * 100)}_overlap, round(max(overlap / CAST(k AS DOUBLE)) FILTER (WHERE share = {s}), 8) AS top{round(s * 100)}_recall" for s in _SHARES)}
    FROM m JOIN sp USING (model) JOIN kp USING (model) JOIN ov USING (model) GROUP BY ALL""")
def evaluate_report(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.evaluate(long_pairs(spark, d), shares=_SHARES)
    out = out.withColumns({c: F.col(c).cast("long") for c in ("concordant", "discordant")})
    return rounded(rounded(out, 8, "r2", "pearson", "spearman", "tau", *[f"top{round(s * 100)}_recall" for s in _SHARES]), 4, "mae", "rmse")


@query(f"""WITH {_PAIRS}, {_MOMENTS}, u AS (SELECT model, metric, value FROM (SELECT model, CAST(n AS DOUBLE) AS n, r2, mae, rmse, pearson FROM m) UNPIVOT (value FOR metric IN (n, r2, mae, rmse, pearson)))
    SELECT metric, round(max(value) FILTER (WHERE model = 'a'), 4) AS a, round(max(value) FILTER (WHERE model = 'b'), 4) AS b FROM u GROUP BY metric""")
def report_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pivoted(metrics.melted(metrics.basic_report(long_pairs(spark, d), ["model"])), ["a", "b"]), 4, "a", "b")


@query(f"""WITH {_PAIRS} SELECT id, rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / 2.0 AS average, row_number() OVER (ORDER BY pb, id) - 1 AS ordinal, dense_rank() OVER (ORDER BY pb) AS dense FROM base""")
def global_ranks(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.with_ranks(written(wide_pairs(spark, d)), "pb", {m: (m, False) for m in ("average", "ordinal", "dense")})
    return out.select("id", "average", (F.col("ordinal") - 1).alias("ordinal"), "dense")


@query(f"""WITH {_PAIRS}, o AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY truth, id) AS rt, row_number() OVER (PARTITION BY model ORDER BY pred, id) AS rp FROM pairs)
    SELECT model, round(corr(rt, rp), 8) AS spearman FROM o GROUP BY model""")
def spearman_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.spearman(long_pairs(spark, d), ["model"], "ordinal"), 8, "spearman")


@query(f"""WITH {_PAIRS}, {_KENDALL} SELECT model, concordant, discordant, tx AS tied_x_only, ty AS tied_y_only, txy AS tied_both FROM kp""")
def kendall_counts(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.kendall(long_pairs(spark, d), keys=["model"])
    return out.select("model", *[F.col(c).cast("long").alias(c) for c in ("concordant", "discordant", "tied_x_only", "tied_y_only", "tied_both")])


_CURVE = tuple(round(0.01 + i * 0.59 / 59, 6) for i in range(60))


@query(f"""WITH {_PAIRS}, {_top(_CURVE)} SELECT model, share, k, overlap, round(overlap / CAST(k AS DOUBLE), 8) AS recall, round(overlap / CAST(k AS DOUBLE), 8) AS precision, round(overlap / CAST(2 * k - overlap AS DOUBLE), 8) AS jaccard, share AS baseline FROM ov""")
def recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.top_k_curve(long_pairs(spark, d), _CURVE, keys=["model"]), 8, "recall", "precision", "jaccard")


@query("""SELECT count(DISTINCT o_orderkey) AS n_left, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_right,
        count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS unmatched_left,
        (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unmatched_right, count(*) = 0 AS is_empty FROM orders""")
def pair_check(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return metrics.pair_check(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct())


@query(f"""WITH {_PAIRS}, r AS (SELECT least(min(truth), min(pa), min(pb)) AS lo, greatest(max(truth), max(pa), max(pb)) AS hi FROM base)
    SELECT id, round((truth - lo) / (hi - lo), 9) AS truth_scaled, round((pa - lo) / (hi - lo), 9) AS pa_scaled, round((pb - lo) / (hi - lo), 9) AS pb_scaled FROM base, r""")
def joint_scaling(spark: SparkSession, d: str) -> DataFrame:
    cols = ["truth_scaled", "pa_scaled", "pb_scaled"]
    return rounded(metrics.joint_min_max(wide_pairs(spark, d), ["truth", "pa", "pb"]).select("id", *cols), 9, *cols)


def _bins(x: str, y: str, source: str) -> str:
    return f"""e AS (SELECT list_distinct(quantile_cont({x}, [{", ".join(f"{i / 10}" for i in range(11))}])) AS q FROM {source}),
    es AS (SELECT list_sort(q) AS q FROM e),
    ab AS (SELECT {x} AS x, {y} AS y, q, least(len(list_filter(q, lambda v: v <= {x})), len(q) - 1) - 1 AS bin FROM {source}, es),
    tr AS (SELECT bin, q[bin + 1] AS low, q[bin + 2] AS high, count(*) AS n, avg(x) AS x_mean, avg(y) AS y_mean, 1.96 * stddev_samp(y) / sqrt(count(*)) AS half_width FROM ab WHERE bin >= 0 GROUP BY ALL HAVING count(*) >= 3)"""


_BIN_COLUMNS = ["low", "high", "x_mean", "y_mean", "half_width"]


@query(f"""WITH {_PAIRS}, {_bins("pb", "truth", "base")} SELECT CAST(bin AS INTEGER) AS bin, n, {", ".join(f"round({c}, 4) AS {c}" for c in _BIN_COLUMNS)} FROM tr""")
def binned_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bin_trend(wide_pairs(spark, d), "pb", "truth"), 4, *_BIN_COLUMNS)


_GAIN = "g AS (SELECT id, (SELECT max(pb) FROM base) - pb AS x, abs(pb - truth) - abs(pa - truth) AS y FROM base)"


@query(f"""WITH {_PAIRS}, {_GAIN}, {_bins("x", "y", "g")} SELECT CAST(bin AS INTEGER) AS bin, n, {", ".join(f"round({c}, 4) AS {c}" for c in _BIN_COLUMNS)} FROM tr""")
def error_gain_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.error_gain_trend(wide_pairs(spark, d), "truth", "pb", "pa", "pb")[1], 4, *_BIN_COLUMNS)


@query(f"""WITH {_PAIRS}, {_GAIN}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM g)
    SELECT round(corr(a, b), 8) AS spearman FROM r""")
def error_gain_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.error_gain_trend(wide_pairs(spark, d), "truth", "pb", "pa", "pb")[0], 8, "spearman")


@query(f"""WITH {_PAIRS}, r AS (SELECT row_number() OVER (ORDER BY truth, id) - 1 AS a, row_number() OVER (ORDER BY pa, id) - 1 AS b, count(*) OVER () AS n FROM base),
    s AS (SELECT a / (CAST(n AS DOUBLE) / 15) AS u, b / (CAST(n AS DOUBLE) / 8) AS v FROM r),
    h AS (SELECT u, v, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM s),
    t AS (SELECT *, pow(u - i1, 2) + 3 * pow(v - j1, 2) < pow(u - i2 - 0.5, 2) + 3 * pow(v - j2 - 0.5, 2) AS near FROM h)
    SELECT CASE WHEN near THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN near THEN i1 ELSE i2 END AS INTEGER) AS i, CAST(CASE WHEN near THEN j1 ELSE j2 END AS INTEGER) AS j, count(*) AS n FROM t GROUP BY ALL""")
def rank_hexagons(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.ranked_pairs(wide_pairs(spark, d).withColumnRenamed("pa", "pred"))
    return metrics.hex_bins(r.select((F.col("to") - 1).alias("a"), (F.col("po") - 1).alias("b"), "n"), "a", "b", 0.0, F.col("n"))


_HEX = """SELECT model, CASE WHEN near THEN 0 ELSE 1 END AS lattice, CASE WHEN near THEN i1 ELSE i2 END AS i, CASE WHEN near THEN j1 ELSE j2 END AS j, count(*) AS c FROM (
        SELECT *, pow(u - i1, 2) + 3 * pow(v - j1, 2) < pow(u - i2 - 0.5, 2) + 3 * pow(v - j2 - 0.5, 2) AS near FROM (
            SELECT model, u, v, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM (
                SELECT model, (row_number() OVER (PARTITION BY model ORDER BY truth, id) - 1) / (CAST(count(*) OVER (PARTITION BY model) AS DOUBLE) / 15) AS u,
                    (row_number() OVER (PARTITION BY model ORDER BY pred, id) - 1) / (CAST(count(*) OVER (PARTITION BY model) AS DOUBLE) / 8) AS v FROM pairs))) GROUP BY ALL"""
_SCALED = _PAIRS.replace("pairs AS (SELECT 'a' AS model, id, truth, pa AS pred FROM base UNION ALL SELECT 'b', id, truth, pb FROM base)", """
    sp0 AS (SELECT least(min(truth), min(pa), min(pb)) AS lo, greatest(max(truth), max(pa), max(pb)) AS hi FROM base),
    pairs AS (SELECT 'a' AS model, id, (truth - lo) / (hi - lo) AS truth, (pa - lo) / (hi - lo) AS pred FROM base, sp0 UNION ALL SELECT 'b', id, (truth - lo) / (hi - lo), (pb - lo) / (hi - lo) FROM base, sp0)""")


@query(f"""WITH {_SCALED}, {_MOMENTS}, {_KENDALL}, {_top(_SHARES)}, hx AS ({_HEX})
    SELECT 'report' AS part, model, metric AS name, round(value, 7) AS value FROM (
        SELECT m.model, CAST(n AS DOUBLE) AS n, r2, mae, rmse, pearson, spearman, CAST(concordant AS DOUBLE) AS concordant, CAST(discordant AS DOUBLE) AS discordant,
            (concordant - discordant) / sqrt(CAST(concordant + discordant + tx AS DOUBLE) * (concordant + discordant + ty)) AS tau FROM m JOIN sp USING (model) JOIN kp USING (model))
        UNPIVOT (value FOR metric IN (n, r2, mae, rmse, pearson, spearman, concordant, discordant, tau))
    UNION ALL SELECT 'report', model, 'top' || CAST(round(share * 100) AS INTEGER) || '_' || what, round(CASE what WHEN 'overlap' THEN overlap ELSE overlap / CAST(k AS DOUBLE) END, 7) FROM ov, (VALUES ('overlap'), ('recall')) w(what)
    UNION ALL SELECT 'curve', model, 'k' || k, CAST(overlap AS DOUBLE) FROM ov
    UNION ALL SELECT 'hexagons', model, concat_ws('_', CAST(lattice AS INTEGER), CAST(i AS INTEGER), CAST(j AS INTEGER)), CAST(c AS DOUBLE) FROM hx""")
def evaluation_job(spark: SparkSession, d: str) -> DataFrame:
    """Joint scaling, report, recall curve and rank hexagons of two models in one job."""
    report, curve, hexagons = metrics.evaluation(wide_pairs(spark, d), "truth", {"a": "pa", "b": "pb"}, _SHARES)
    long = metrics.melted(report).select(F.lit("report").alias("part"), "model", F.col("metric").alias("name"), "value")
    long = long.unionByName(curve.select(F.lit("curve").alias("part"), "model", F.concat(F.lit("k"), F.col("k").cast("string")).alias("name"), F.col("overlap").cast("double").alias("value")))
    long = long.unionByName(hexagons.select(F.lit("hexagons").alias("part"), "model", F.concat_ws("_", *[F.col(c).cast("string") for c in ("lattice", "i", "j")]).alias("name"), F.col("n").cast("double").alias("value")))
    return rounded(long, 7, "value")


# ---- gridded fields ----

_RAW = "raw AS (SELECT CAST(l_partkey % 61 AS INTEGER) AS y, CAST(l_suppkey % 61 AS INTEGER) AS x, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value FROM lineitem GROUP BY 1, 2)"
_TARGET = """target AS (
    SELECT y, x, (v - lo) / (hi - lo) AS value FROM (
        SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (
            SELECT CAST(l_orderkey % 51 AS INTEGER) AS y, CAST(l_partkey % 51 AS INTEGER) AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS v FROM lineitem GROUP BY 1, 2)
        WHERE (y * 51 + x) % 9 < 5))"""


def raw_grid(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 61).cast("int").alias("y"), (F.col("l_suppkey") % 61).cast("int").alias("x")).agg((F.sum(F.floor(F.col("l_extendedprice") * 100)).cast("double") / F.count("*")).alias("value"))


def target_grid(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    g = li.groupBy((F.col("l_orderkey") % 51).cast("int").alias("y"), (F.col("l_partkey") % 51).cast("int").alias("x")).agg((F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count("*")).alias("v"))
    g = g.where((fields.flatten_index(F.col("y"), F.col("x"), 51) % 9) < 5)
    return metrics.min_max(g, "v", name="value").select("y", "x", "value")


_OFFSETS = f"""{_RAW}, {_TARGET},
    c AS (SELECT dy, dx, r.value, t.value AS want FROM target t, range(11) a(dy), range(11) b(dx), raw r WHERE r.y = t.y + dy AND r.x = t.x + dx),
    s AS (SELECT *, min(value) OVER (PARTITION BY dy, dx) AS lo, max(value) OVER (PARTITION BY dy, dx) AS hi FROM c),
    o AS (SELECT CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, count(*) AS n_valid, avg(abs(coalesce((value - lo) / nullif(hi - lo, 0), value) - want)) AS diff FROM s GROUP BY ALL)"""


@query(f"WITH {_OFFSETS} SELECT dy, dx, n_valid, round(diff, 9) AS diff FROM o")
def offset_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fields.offset_errors(raw_grid(spark, d), target_grid(spark, d), 10, 10, complete_only=False), 9, "diff")


@query(f"""WITH {_OFFSETS} SELECT dy, dx, n_valid, round(diff, 9) AS diff FROM (SELECT * FROM o ORDER BY diff, dy, dx LIMIT 1)""")
def bounded_search(spark: SparkSession, d: str) -> DataFrame:
    """The best offset by bounds over pieces of rows, without all cells at all offsets."""
    return rounded(search.find_offset(raw_grid(spark, d), target_grid(spark, d), 10, 10, complete_only=False).drop("n_tried"), 9, "diff")


_PATCH = f"""{_OFFSETS}, best AS (SELECT dy, dx FROM o ORDER BY diff, dy, dx LIMIT 1),
    p AS (SELECT t.y, t.x, r.value FROM best, target t JOIN raw r ON r.y = t.y + (SELECT dy FROM best) AND r.x = t.x + (SELECT dx FROM best))"""


@query(f"""WITH {_PATCH} SELECT p.y * 51 + p.x AS local_index, (p.y + dy) * 61 + p.x + dx AS global_index, p.y, p.x, dy, dx,
        round((value - (SELECT min(value) FROM p)) / ((SELECT max(value) FROM p) - (SELECT min(value) FROM p)), 9) AS scaled FROM p, best""")
def aligned_patch(spark: SparkSession, d: str) -> DataFrame:
    raw, target = raw_grid(spark, d), target_grid(spark, d)
    best = fields.best_offset(fields.offset_errors(raw, target, 10, 10, complete_only=False)).select("dy", "dx")
    out = fields.patch_at(raw, target, best)
    local = fields.flatten_index(F.col("y"), F.col("x"), 51)
    world = fields.flatten_index(F.col("y") + F.col("dy"), F.col("x") + F.col("dx"), 61)
    return rounded(out.select(local.alias("local_index"), world.alias("global_index"), "y", "x", "dy", "dx", "scaled"), 9, "scaled")


@query(f"""WITH {_TARGET}, c AS (SELECT CAST(i // 61 AS INTEGER) AS y, CAST(i % 61 AS INTEGER) AS x FROM range(3721) r(i))
    SELECT c.y, c.x, round(coalesce(t.value, 1.0), 9) AS value FROM c LEFT JOIN target t ON t.y + 5 = 60 - c.y AND t.x + 5 = c.x""")
def embedded_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fields.flip(fields.embed(target_grid(spark, d), 61, 61, 5, 5, 1.0), 61).select("y", "x", "value"), 9, "value")


@query(f"""WITH {_RAW}, c AS (SELECT * FROM raw WHERE y BETWEEN 10 AND 39 AND x BETWEEN 5 AND 44),
    g AS (SELECT CAST(i // 40 AS INTEGER) AS y, CAST(i % 40 AS INTEGER) AS x FROM range(1200) r(i))
    SELECT g.y, g.x, round(c.value, 6) AS value, round(ln(c.value - (SELECT min(value) FROM c) + 1), 8) AS shifted FROM g LEFT JOIN c ON c.y - 10 = g.y AND c.x - 5 = g.x""")
def cut_and_shift(spark: SparkSession, d: str) -> DataFrame:
    part = fields.cut(fields.present(raw_grid(spark, d)), 10, 5, 30, 40)
    low = part.agg(F.min("value").alias("lo"))
    out = fields.to_dense(part, 30, 40).crossJoin(F.broadcast(low)).withColumn("shifted", E.log_shift(F.col("value"), F.col("lo")))
    return rounded(rounded(out.select("y", "x", "value", "shifted"), 6, "value"), 8, "shifted")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").cast("int").alias("y"), F.col("l_suppkey").cast("int").alias("x"), F.col("l_quantity").alias("r"), (F.col("l_discount") * 1000).alias("g"), (F.col("l_tax") * 1000).alias("b"))


def _edge_sql(a: float, b: float, n: int) -> str:
    return f"list_transform(range({n + 1}), lambda i: CAST(round_even({a} + i * {b - a} / {float(n)}, 0) AS INTEGER))"


@query(f"""WITH e AS (SELECT {_edge_sql(1.0, 1901.0, 50)} AS ey, {_edge_sql(1.0, 96.0, 20)} AS ex),
    a AS (SELECT len(list_filter(ey, lambda v: v <= l_partkey)) - 1 AS y, len(list_filter(ex, lambda v: v <= l_suppkey)) - 1 AS x, l_quantity AS r, l_discount * 1000 AS g, l_tax * 1000 AS b
        FROM lineitem, e WHERE l_partkey >= ey[1] AND l_partkey < ey[-1] AND l_suppkey >= ex[1] AND l_suppkey < ex[-1]),
    t AS (SELECT y, x, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b FROM a GROUP BY y, x)
    SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(r, 8) AS r, round(g, 8) AS g, round(b, 8) AS b FROM t
    WHERE NOT ((r > 0.12 AND g > 0.12 AND b > 0.12) OR (r = 0 AND g = 0 AND b = 0) OR y >= 49 OR x >= 49)""")
def tile_field(spark: SparkSession, d: str) -> DataFrame:
    tiles = fields.tile_means(pixels(spark, d), 50, 20, (1.0, 1901.0), (1.0, 96.0), ["r", "g", "b"])
    return rounded(fields.background(tiles, ["r", "g", "b"], 0.12), 8, "r", "g", "b")


@query("""WITH m AS (SELECT DISTINCT l_linestatus AS map FROM lineitem),
    r AS (SELECT map, edge, row_number() OVER (PARTITION BY map ORDER BY edge) - 1 AS i, max(edge) OVER (PARTITION BY map) AS high FROM (
        SELECT map, CAST(o_totalprice AS DOUBLE) * CASE map WHEN 'F' THEN 0.25 ELSE 0.5 END AS edge FROM orders, m WHERE o_orderkey % 5 = 0)),
    e AS (SELECT map, edge, max(i) AS i, max(high) AS high FROM r GROUP BY map, edge),
    v AS (SELECT l_linestatus AS map, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem),
    a AS (SELECT v.map, CASE WHEN v.v < e.high THEN e.i END AS tile FROM v ASOF LEFT JOIN e ON v.map = e.map AND v.v >= e.edge)
    SELECT map, CAST(tile AS INTEGER) AS tile, count(*) AS n FROM a GROUP BY map, tile""")
def tiles_of_many_edges(spark: SparkSession, d: str) -> DataFrame:
    """Line prices counted between edges that are orders' prices, other ones for each of two maps."""
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("map"), F.col("l_extendedprice").cast("double").alias("v"))
    price = F.col("o_totalprice").cast("double") * F.when(F.col("map") == "F", 0.25).otherwise(0.5)
    maps = li.select("map").distinct()  # two rows
    edges = table(spark, d, "orders").where("o_orderkey % 5 = 0").crossJoin(F.broadcast(maps)).select("map", price.alias("edge"))
    return fields.tiles_by_table(li, "v", edges, ["map"]).groupBy("map", "tile").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT {_edge_sql(1.0, 1901.0, 50)} AS ey, {_edge_sql(1.0, 96.0, 20)} AS ex),
    a AS (SELECT len(list_filter(ey, lambda v: v <= l_partkey)) - 1 AS y, len(list_filter(ex, lambda v: v <= l_suppkey)) - 1 AS x, l_quantity AS r, l_discount * 1000 AS g, l_tax * 1000 AS b
        FROM lineitem, e WHERE l_partkey >= ey[1] AND l_partkey < ey[-1] AND l_suppkey >= ex[1] AND l_suppkey < ex[-1]),
    t AS (SELECT y, x, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b FROM a GROUP BY y, x),
    k AS (SELECT y, x, r, g, b FROM t WHERE NOT ((r > 0.12 AND g > 0.12 AND b > 0.12) OR (r = 0 AND g = 0 AND b = 0) OR y >= 49 OR x >= 49)),
    pl AS (SELECT s_suppkey AS idx, s_acctbal AS value, ((s_suppkey * 7) % 53) / CAST(255 AS DOUBLE) AS cr, ((s_suppkey * 11) % 101) / CAST(255 AS DOUBLE) AS cg, ((s_suppkey * 13) % 83) / CAST(255 AS DOUBLE) AS cb FROM supplier),
    n AS (SELECT y, x, min(struct_pack(d := round(sqrt((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)), 9), i := idx)).i AS idx FROM k, pl GROUP BY y, x),
    f AS (SELECT y, x, ln(value - min(value) OVER () + 1) AS v FROM n JOIN pl USING (idx)),
    s AS (SELECT 49 - y AS y, x, coalesce((v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0), v) AS v FROM f),
    c AS (SELECT CAST(i // 20 AS INTEGER) AS y, CAST(i % 20 AS INTEGER) AS x FROM range(1000) r(i))
    SELECT c.y, c.x, round(s.v, 8) + 0.0 AS value FROM c LEFT JOIN s ON s.y = c.y AND s.x = c.x""")
def activity_field(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to a scaled map, with the suppliers as the palette."""
    k, part = F.col("s_suppkey"), lambda m, n: ((F.col("s_suppkey") * m) % n) / F.lit(255.0)
    palette = table(spark, d, "supplier").select(k.alias("idx"), F.col("s_acctbal").alias("value"), F.array(part(7, 53), part(11, 101), part(13, 83)).alias("code"))
    return rounded(fields.activity_field(pixels(spark, d), palette, 50, 20, (1.0, 1901.0), (1.0, 96.0), ["r", "g", "b"], 0.12), 8, "value")


_ALIGN = """li AS (SELECT l_linestatus AS m, l_partkey, l_suppkey, l_orderkey, l_extendedprice, l_quantity, l_discount FROM lineitem),
    rw AS (SELECT m, CAST(l_partkey % 21 AS INTEGER) AS y, CAST(l_suppkey % 21 AS INTEGER) AS x, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS q,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS e0 FROM li GROUP BY 1, 2, 3),
    tg AS (SELECT m, y, x, (v - min(v) OVER (PARTITION BY m)) / (max(v) OVER (PARTITION BY m) - min(v) OVER (PARTITION BY m)) AS value FROM (
        SELECT m, CAST(l_orderkey % 15 AS INTEGER) AS y, CAST(l_partkey % 15 AS INTEGER) AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS v FROM li GROUP BY 1, 2, 3) WHERE (y * 15 + x) % 9 < 5),
    ac AS (SELECT t.m, dy, dx, r.value, t.value AS want FROM tg t, range(7) a(dy), range(7) b(dx), rw r WHERE r.m = t.m AND r.y = t.y + dy AND r.x = t.x + dx),
    asp AS (SELECT *, min(value) OVER (PARTITION BY m, dy, dx) AS lo, max(value) OVER (PARTITION BY m, dy, dx) AS hi FROM ac),
    ao AS (SELECT m, dy, dx, avg(abs(coalesce((value - lo) / nullif(hi - lo, 0), value) - want)) AS diff FROM asp GROUP BY ALL),
    ab AS (SELECT m, dy, dx FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY diff, dy, dx) AS k FROM ao) WHERE k = 1),
    ap AS (SELECT t.m, t.y, t.x, ab.dy, ab.dx, r.value, r.q, r.e0 FROM tg t JOIN ab ON ab.m = t.m JOIN rw r ON r.m = t.m AND r.y = t.y + ab.dy AND r.x = t.x + ab.dx)"""


@query(f"""WITH {_ALIGN} SELECT m AS map, y * 15 + x AS local_index, CAST((y + dy) * 21 + x + dx AS INTEGER) AS global_index, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), value), 8) + 0.0 AS scaled,
        round(coalesce((q - min(q) OVER w) / nullif(max(q) OVER w - min(q) OVER w, 0), q), 8) + 0.0 AS quantity, round(e0, 8) AS e0 FROM ap WINDOW w AS (PARTITION BY m)""")
def align_maps(spark: SparkSession, d: str) -> DataFrame:
    """Two maps at once: the offset found for the price map is applied to a map of quantities and to a composition; the patch goes through a CSV."""
    li = table(spark, d, "lineitem").withColumn("map", F.col("l_linestatus"))
    cell = [F.col("map"), (F.col("l_partkey") % 21).cast("int").alias("y"), (F.col("l_suppkey") % 21).cast("int").alias("x")]
    mean = lambda c: F.sum(c.cast("long")).cast("double") / F.count("*")
    grid = written(li.groupBy(*cell).agg(mean(F.floor(F.col("l_extendedprice") * 100)).alias("value"), mean(F.col("l_quantity")).alias("q"), mean(F.round(F.col("l_discount") * 100)).alias("e0")))
    target = li.groupBy("map", (F.col("l_orderkey") % 15).cast("int").alias("y"), (F.col("l_partkey") % 15).cast("int").alias("x")).agg(mean(F.col("l_quantity")).alias("v"))
    target = written(metrics.min_max(target.where((fields.flatten_index(F.col("y"), F.col("x"), 15) % 9) < 5), "v", ["map"], "value").select("map", "y", "x", "value"))
    out = fields.align_fields(grid.select("map", "y", "x", "value"), target, {"quantity": grid.select("map", "y", "x", F.col("q").alias("value"))}, grid.select("map", "y", "x", "e0"), 6, 6, 15, 21, ["map"], complete_only=False)
    columns, path = ["map", "local_index", "global_index", "scaled", "quantity", "e0"], _scratch(spark)
    files.write_csv(rounded(out, 8, "scaled", "quantity", "e0"), path, columns)
    return spark.read.csv(path, header=True, schema="map string, local_index int, global_index int, scaled double, quantity double, e0 double")


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding AS code FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16)),
    d AS (SELECT e.vec_id, b.idx, sqrt(list_sum(list_transform(list_zip(e.embedding, b.code), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS dist FROM embeddings e, b)
    SELECT vec_id, CAST(arg_min(idx, dist) AS INTEGER) AS idx, round(min(dist), 6) AS dist FROM d GROUP BY vec_id""")
def nearest_codeword(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    book = e.orderBy("vec_id").limit(16)  # the codebook, as the survey states it
    first = F.row_number().over(ranking.Window.orderBy("vec_id")) - 1
    codes = book.select(first.alias("idx"), F.col("v").alias("code"))
    return rounded(fields.nearest_code(e, codes, "v").select("vec_id", "idx", "dist"), 6, "dist")


@query("""WITH c AS (SELECT p_partkey AS idx, (p_partkey * 7919 % 1009) / CAST(10 AS DOUBLE) AS a, (p_partkey * 104729 % 997) / CAST(10 AS DOUBLE) AS b, p_retailprice / 20 AS c FROM part),
    e AS (SELECT event_id, (event_id * 31 % 1030) / CAST(10 AS DOUBLE) AS a, (event_id * 131 % 991) / CAST(10 AS DOUBLE) AS b, (event_id * 17 % 1200) / CAST(20 AS DOUBLE) + 45 AS c FROM events),
    d AS (SELECT event_id, idx, sqrt((e.a - c.a) * (e.a - c.a) + (e.b - c.b) * (e.b - c.b) + (e.c - c.c) * (e.c - c.c)) AS dist FROM e, c)
    SELECT event_id, k.i AS idx, round(k.d, 6) AS dist FROM (SELECT event_id, min(struct_pack(r := round(dist, 9), i := idx, d := dist)) AS k FROM d GROUP BY event_id)""")
def nearest_colours(spark: SparkSession, d: str) -> DataFrame:
    """Events matched with the parts as a palette that grows with the data, by the grid."""
    key, e = F.col("p_partkey"), F.col("event_id")
    codes = table(spark, d, "part").select(key.alias("idx"), F.array((key * 7919 % 1009) / F.lit(10.0), (key * 104729 % 997) / F.lit(10.0), F.col("p_retailprice") / 20).alias("code"))
    rows = table(spark, d, "events").select("event_id", F.array((e * 31 % 1030) / F.lit(10.0), (e * 131 % 991) / F.lit(10.0), (e * 17 % 1200) / F.lit(20.0) + 45).alias("v"))
    return rounded(fields.nearest_code(rows, codes, "v").select("event_id", "idx", "dist"), 6, "dist")


_MIX = """ce AS (SELECT 'e' || (n_nationkey % 5) AS element, CAST((n_nationkey * 7) % 61 AS DOUBLE) AS mux, CAST((n_nationkey * 11) % 61 AS DOUBLE) AS muy, CAST(6.0 AS DOUBLE) AS sigma FROM nation),
    mx AS (SELECT CAST(l_partkey % 61 AS INTEGER) AS y, CAST(l_suppkey % 61 AS INTEGER) AS x FROM lineitem GROUP BY 1, 2),
    f AS (SELECT y, x, element, sum(exp(-(pow(x - mux, 2) + pow(y - muy, 2)) / (2.0 * pow(sigma, 2)))) AS value FROM mx, ce GROUP BY y, x, element)"""


def mixture_field(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    centres = table(spark, d, "nation").select(F.concat(F.lit("e"), (key % 5).cast("string")).alias("element"), ((key * 7) % 61).cast("double").alias("mux"), ((key * 11) % 61).cast("double").alias("muy"), F.lit(6.0).alias("sigma"))
    return fields.mixture(raw_grid(spark, d).select("y", "x"), centres)


@query(f"WITH {_MIX} SELECT y, x, element, round(value, 9) AS value, round(value / CASE WHEN sum(value) OVER (PARTITION BY y, x) = 0 THEN 1 ELSE sum(value) OVER (PARTITION BY y, x) END, 8) AS share FROM f")
def mixture_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(fields.shares(mixture_field(spark, d), ["y", "x"]), 9, "value"), 8, "share")


_BUMPS = """ce AS (SELECT p_partkey % 4 AS element, (p_partkey * 7919 % 6100) / CAST(100 AS DOUBLE) AS mux, (p_partkey * 104729 % 6100) / CAST(100 AS DOUBLE) AS muy, (p_size + 5) / CAST(50 AS DOUBLE) AS sigma FROM part),
    mx AS (SELECT CAST(l_partkey % 61 AS INTEGER) AS y, CAST(l_suppkey % 61 AS INTEGER) AS x FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {_BUMPS} SELECT y, x, element, round(sum(exp(-(pow(x - mux, 2) + pow(y - muy, 2)) / (2.0 * pow(sigma, 2)))), 8) AS value FROM mx, ce GROUP BY y, x, element")
def mixture_within_reach(spark: SparkSession, d: str) -> DataFrame:
    """A bump for every part, of a reach of its own, met by the cells within it."""
    key = F.col("p_partkey")
    centres = table(spark, d, "part").select((key % 4).alias("element"), ((key * 7919 % 6100) / F.lit(100.0)).alias("mux"), ((key * 104729 % 6100) / F.lit(100.0)).alias("muy"), ((F.col("p_size") + 5) / F.lit(50.0)).alias("sigma"))
    return rounded(fields.mixture(raw_grid(spark, d).select("y", "x"), centres), 8, "value")


_ELEMENTS = [f"e{i}" for i in range(5)]


@query(f"""WITH {_MIX}, lk AS (SELECT y, x, element, least(255, floor(greatest(0.0, least(1.0, round(value, 9))) * 256)) / 255.0 AS v FROM f),
    s AS (SELECT y, x, element, v / CASE WHEN sum(v) OVER (PARTITION BY y, x) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY y, x) END AS share FROM lk),
    c AS (SELECT y, x, {", ".join(f"CAST(trunc(round(512 * coalesce(max(share) FILTER (WHERE element = '{e}'), 0), 7)) AS INTEGER) AS {e}" for e in _ELEMENTS)} FROM s GROUP BY y, x),
    t AS (SELECT *, {" + ".join(_ELEMENTS)} AS n FROM c)
    SELECT y, x, {", ".join(f"{e} / 512.0 AS {e}" for e in _ELEMENTS[:-1])}, (CASE WHEN n > 0 THEN e4 + 512 - n ELSE e4 END) / 512.0 AS e4 FROM t""")
def composition_map(spark: SparkSession, d: str) -> DataFrame:
    lut = spark.range(256).crossJoin(F.broadcast(mixture_field(spark, d).select("element").distinct())).select("element", F.col("id").cast("int").alias("idx"), (F.col("id") / 255.0).alias("v"))
    stepped = fields.step_lookup(rounded(mixture_field(spark, d), 9, "value"), lut, "value")
    # shares are nudged to 7 digits of a part, so that engines that add in another order round alike
    parts = fields.shares(stepped, ["y", "x"]).withColumn("share", F.round(F.col("share") * 512, 7) / 512)
    return fields.composition(parts, _ELEMENTS)


@query(f"""WITH {_RAW}, {_TARGET}, r AS (SELECT y, x, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM raw)
    SELECT round(sqrt(avg(CASE WHEN r.y = 30 OR r.x = 30 THEN 0 ELSE pow(r.value - t.value, 2) END)), 9) AS rmse FROM r JOIN target t ON r.y = t.y AND r.x = t.x""")
def cross_masked_rmse(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.min_max(raw_grid(spark, d), "value").select("y", "x", F.col("scaled").alias("value"))
    return rounded(fields.masked_rmse(r.join(target_grid(spark, d).withColumnRenamed("value", "other"), ["y", "x"]), 30, 30), 9, "rmse")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(coalesce((l_quantity - lo) / nullif(hi - lo, 0), l_quantity), 9) AS scaled FROM (
        SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS lo, max(l_quantity) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""")
def group_scaling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.min_max(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", ["l_orderkey"]), 9, "scaled")


@query("""SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, count(*) AS n, round(sum((l_extendedprice - m) / s), 5) + 0.0 AS z_total, round(max(((l_extendedprice - m) / s) * s + m), 6) AS back
    FROM lineitem JOIN (SELECT l_suppkey AS k, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON k = l_suppkey GROUP BY l_suppkey""")
def normalised_prices(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("v"))
    z = E.z_score(F.col("v"), F.col("mean"), F.col("std"))
    out = li.join(metrics.normaliser(li, "v", ["l_suppkey"]), "l_suppkey").groupBy("l_suppkey", "mean", "std")
    out = out.agg(F.count("*").alias("n"), F.sum(z).alias("z_total"), F.max(E.inverse_z_score(z, F.col("mean"), F.col("std"))).alias("back"))
    return rounded(rounded(out, 6, "mean", "std", "back"), 5, "z_total")


# ---- trajectories and splits ----

@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried,
        round(exp(least((50.0 - value) / (CAST(8.617e-5 AS DOUBLE) * 4000.0 * 100), 0)), 8) AS chance, round((4000.0 - 298.0) * (1 - (event_id % 5000 + 1) / CAST(5000 AS DOUBLE)) + 298.0, 8) AS temperature FROM events""")
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") == "purchase")
    out = metrics.carry_forward(e, ["user_id"], ["ts", "event_id"], "value", "ok")
    chance, t = E.acceptance(F.lit(50.0), F.col("value"), F.lit(400000.0)), E.cooling(F.col("event_id") % 5000, 5000)
    return rounded(out.select("user_id", "event_id", "carried", chance.alias("chance"), t.alias("temperature")), 8, "chance", "temperature")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 100003, doc_id) AS p, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN p <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN p > n - CAST(floor(n * 0.1) AS BIGINT) THEN 'test' WHEN p > n - CAST(floor(n * 0.1) AS BIGINT) - CAST(floor(n * 0.2) AS BIGINT) THEN 'val' END AS part FROM p""")
def document_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", ((F.col("doc_id") * 7919) % 100003).alias("o"))
    return ranking.split_rows(docs, "o", "doc_id", 0.7, 0.2, 0.1).select("doc_id", "part")


# ---- sites, neighbours, graphs ----

# Fixed value: the lattice constant of the slab.
_A = 3.967202998841584
_D, _H = _A / 2**0.5, _A / 3**0.5
_A1, _A2 = (_D, 0.0, 0.0), (_D / 2, _D * 3**0.5 / 2, 0.0)


def lattice(spark: SparkSession) -> DataFrame:
    """512 sites of an 8 x 8 x 8 slab; the formula is the geometry, the data are the configurations."""
    s = spark.range(512).select(F.col("id").cast("int").alias("node"), F.floor(F.col("id") / 64).alias("k"), (F.floor(F.col("id") / 8) % 8).alias("j"), (F.col("id") % 8).alias("i"))
    u, v = F.col("i") + F.col("k") / 3.0, F.col("j") + F.col("k") / 3.0
    return s.select(F.lit(0).alias("graph"), "node", (u * _A1[0] + v * _A2[0]).alias("x"), (v * _A2[1]).alias("y"), (F.col("k") * _H).alias("z"))


_LATTICE = f"""st AS (SELECT CAST(id AS INTEGER) AS node, (i + k / CAST(3 AS DOUBLE)) * {_A1[0]!r} + (j + k / CAST(3 AS DOUBLE)) * {_A2[0]!r} AS x, (j + k / CAST(3 AS DOUBLE)) * {_A2[1]!r} AS y, k * {_H!r} AS z, k
        FROM (SELECT id, id // 64 AS k, (id // 8) % 8 AS j, id % 8 AS i FROM range(512) r(id))),
    ed AS (SELECT a.node, b.node AS nbr, sqrt(pow(b.x + p * {8 * _A1[0]!r} + q * {8 * _A2[0]!r} - a.x, 2) + pow(b.y + q * {8 * _A2[1]!r} - a.y, 2) + pow(b.z - a.z, 2)) AS dist
        FROM st a, st b, (VALUES (-1), (0), (1)) v1(p), (VALUES (-1), (0), (1)) v2(q) WHERE NOT (a.node = b.node AND p = 0 AND q = 0)),
    near AS (SELECT * FROM ed WHERE dist <= 3.2),
    tg AS (SELECT node AS site, CAST((row_number() OVER (ORDER BY z DESC, node) - 1) // 64 AS INTEGER) AS layer FROM st),
    zn AS (SELECT site AS node, site AS nbr, 1 AS zone FROM tg WHERE layer = 0 UNION ALL
        SELECT n.node, n.nbr, b.layer + 2 FROM near n JOIN tg a ON a.site = n.node AND a.layer = 0 JOIN tg b ON b.site = n.nbr AND b.layer <= 1)"""


def lattice_edges(spark: SparkSession) -> DataFrame:
    return sites.neighbours(lattice(spark), 3.2, period=[tuple(8 * c for c in _A1), tuple(8 * c for c in _A2)])


_CONFIG = "cf AS (SELECT s_suppkey AS config, node AS site, CAST((s_suppkey * 31 + node * 17 + (s_suppkey * node) % 7) % 5 AS INTEGER) AS species FROM supplier, st)"
# The linear model's coefficients by zone, for the species Ir, Pd, Pt, Rh, Ru (codes 0 to 4).
_ZONE_1 = [0.490, 1.178, 0.988, 0.744, 0.329]
_ZONE_2 = [0.027, -0.022, 0.023, -0.017, -0.012]
_ZONE_3 = [-0.009, 0.010, -0.015, 0.005, 0.008]
_COEFFICIENTS = {f"z{z}_{s}": w for z, zone in enumerate((_ZONE_1, _ZONE_2, _ZONE_3), 1) for s, w in enumerate(zone)}


def configurations(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("site")
    each = table(spark, d, "supplier").select("s_suppkey").crossJoin(F.broadcast(lattice(spark).select(F.col("node").alias("site"))))
    return each.select(k.alias("config"), "site", ((k * 31 + n * 17 + (k * n) % 7) % 5).cast("int").alias("species"))


_COUNTS = f"""{_LATTICE}, {_CONFIG},
    zc AS (SELECT config, node, {", ".join(f"CAST(count(*) FILTER (WHERE zone = {z} AND species = {s}) AS BIGINT) AS z{z}_{s}" for z in (1, 2, 3) for s in range(5))} FROM zn JOIN cf ON cf.site = zn.nbr GROUP BY config, node)"""


def site_counts(spark: SparkSession, d: str) -> DataFrame:
    tagged = sites.layers(lattice(spark).select(F.col("graph").alias("config"), F.col("node").alias("site"), "z"), 64).select("site", "layer")
    return sites.zone_counts(sites.zones(lattice_edges(spark), tagged), configurations(spark, d), range(5))


@query(f"WITH {_COUNTS} SELECT * FROM zc")
def zone_composition(spark: SparkSession, d: str) -> DataFrame:
    return site_counts(spark, d)


@query(f"""WITH {_COUNTS}, en AS (SELECT config, {" + ".join(f"CAST({w} AS DOUBLE) * {c}" for c, w in _COEFFICIENTS.items())} AS e FROM zc)
    SELECT config, count(*) AS n, round(ln(avg({sites.PREFACTOR!r} * exp(-abs(e - 0.895) / (CAST(8.617e-5 AS DOUBLE) * 298.0)))), 6) AS activity FROM en GROUP BY config""")
def score_configurations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sites.boltzmann(sites.linear_score(site_counts(spark, d), _COEFFICIENTS)), 6, "activity")


_MIXED = ", ".join(f"((s_suppkey * {3 + i}) % 11 + 1)" for i in range(5))


@query(f"""WITH {_LATTICE}, sh AS (SELECT s_suppkey AS config, [{_MIXED}] AS w FROM supplier),
    pa AS (SELECT config, list_transform(w, lambda v: CAST(trunc(512.0 * (v / CAST(list_sum(w) AS DOUBLE))) AS BIGINT)) AS n FROM sh),
    en0 AS (SELECT config, [n[1], n[1] + n[2], n[1] + n[2] + n[3], n[1] + n[2] + n[3] + n[4], 512] AS ends FROM pa),
    cf AS (SELECT config, site, len(list_filter(ends, lambda e: e < p)) AS species FROM (
        SELECT config, node AS site, ends, row_number() OVER (PARTITION BY config ORDER BY (node * 7919 + config * 104729) % 100003, node) AS p FROM en0, st)),
    zc AS (SELECT config, node, {", ".join(f"CAST(count(*) FILTER (WHERE zone = {z} AND species = {s}) AS BIGINT) AS z{z}_{s}" for z in (1, 2, 3) for s in range(5))} FROM zn JOIN cf ON cf.site = zn.nbr GROUP BY config, node),
    en AS (SELECT config, {" + ".join(f"CAST({w} AS DOUBLE) * {c}" for c, w in _COEFFICIENTS.items())} AS e FROM zc)
    SELECT config, count(*) AS n, round(ln(avg({sites.PREFACTOR!r} * exp(-abs(e - 0.895) / (CAST(8.617e-5 AS DOUBLE) * 298.0)))), 6) AS activity FROM en GROUP BY config""")
def score_compositions(spark: SparkSession, d: str) -> DataFrame:
    """A table of compositions to activities: whole parts, shuffled sites, zones, model, average."""
    k = F.col("s_suppkey")
    weights = [((k * (3 + i)) % 11 + 1) for i in range(5)]
    total = sum(weights[1:], weights[0]).cast("double")
    names = [f"w{i}" for i in range(5)]
    table_ = table(spark, d, "supplier").select(k.alias("config"), *[(w / total).alias(n) for w, n in zip(weights, names)])
    order = (F.col("site") * F.lit(7919).cast("long") + F.col("config") * 104729) % 100003
    return rounded(sites.score_compositions(table_, names, lattice(spark).withColumnRenamed("node", "site"), lattice_edges(spark), 64, _COEFFICIENTS, order), 6, "activity")


_POINTS = "pt AS (SELECT label AS graph, CAST(vec_id AS INTEGER) AS node, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, embedding FROM embeddings)"
_NEAR = f"""{_POINTS}, nb AS (SELECT a.graph, a.node, b.node AS nbr, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS dist FROM pt a JOIN pt b ON a.graph = b.graph AND a.node <> b.node),
    nr AS (SELECT *, row_number() OVER (PARTITION BY graph, node ORDER BY dist, nbr) AS place FROM nb WHERE dist <= 0.5),
    k AS (SELECT p.graph, p.node, CAST(g AS INTEGER) AS place, coalesce(nr.nbr, 0) AS nbr, coalesce(nr.dist, 1.5) AS dist, nr.nbr IS NULL AS is_pad FROM pt p CROSS JOIN range(1, 13) r(g) LEFT JOIN nr ON nr.graph = p.graph AND nr.node = p.node AND nr.place = g)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select(F.col("label").alias("graph"), F.col("vec_id").cast("int").alias("node"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"), F.col("embedding").cast("array<double>").alias("features"))


def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return sites.nearest_padded(sites.nearest_within(p, 0.5, 12), p, 12, 1.5)


@query(f"WITH {_NEAR} SELECT graph, node, place, nbr, round(dist, 9) AS dist, is_pad, round(exp(-pow(dist - 5 * CAST(0.2 AS DOUBLE), 2) / {0.2 * 0.2!r}), 8) AS bond_5, 41 AS n_bond FROM k")
def padded_neighbours(spark: SparkSession, d: str) -> DataFrame:
    b = sites.bond_features(nearest_points(spark, d))
    out = b.select("graph", "node", "place", "nbr", "dist", "is_pad", F.get("bond", F.lit(5)).alias("bond_5"), F.size("bond").alias("n_bond"))
    return rounded(rounded(out, 9, "dist"), 8, "bond_5")


@query(f"""WITH {_NEAR}, j AS (SELECT k.graph, k.node, CAST(o.embedding[4] AS DOUBLE) * 3 AS gate, CAST(n.embedding[5] AS DOUBLE) * 3 AS core FROM k JOIN pt o ON o.graph = k.graph AND o.node = k.node JOIN pt n ON n.graph = k.graph AND n.node = k.nbr WHERE NOT is_pad)
    SELECT graph, node, round(sum(1 / (1 + exp(-gate)) * (greatest(core, 0) + ln(1 + exp(-abs(core))))), 8) AS message FROM j GROUP BY graph, node""")
def gated_messages(spark: SparkSession, d: str) -> DataFrame:
    both = sites.gather(nearest_points(spark, d).where("not is_pad"), points(spark, d))
    return rounded(sites.gated_sum(both, F.get("features", F.lit(3)) * 3, F.get("features", F.lit(64 + 4)) * 3), 8, "message")


_WIDTH = 64


@query(f"WITH {_POINTS} SELECT graph, count(*) AS n, {', '.join(f'round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 8) + 0.0 AS p{i}' for i in range(_WIDTH))}, round(avg(CAST(embedding[1] AS DOUBLE)) * count(*), 7) + 0.0 AS total FROM pt GROUP BY graph")
def pooled_graphs(spark: SparkSession, d: str) -> DataFrame:
    out = sites.mean_pool(points(spark, d), _WIDTH)
    out = out.select("graph", "n", *[F.get("pooled", F.lit(i)).alias(f"p{i}") for i in range(_WIDTH)], (F.get("pooled", F.lit(0)) * F.col("n")).alias("total"))
    return rounded(rounded(out, 8, *[f"p{i}" for i in range(_WIDTH)]), 7, "total")


@query("""WITH n AS (SELECT label AS graph, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS node FROM embeddings), s AS (SELECT graph, count(*) AS c FROM n GROUP BY graph)
    SELECT n.graph, vec_id, CAST(node AS INTEGER) AS node, CAST(node + coalesce((SELECT sum(c) FROM s WHERE s.graph < n.graph), 0) AS BIGINT) AS global_id FROM n""")
def stacked_graph_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("graph"), "vec_id")
    local = ranking.with_position(e, ["graph"], ["vec_id"], "node").withColumn("node", F.col("node").cast("int"))
    return sites.global_ids(local).select("graph", "vec_id", "node", "global_id")


@query(f"""WITH n AS (SELECT label AS graph, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS node, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS f FROM embeddings),
    nb AS (SELECT a.graph, a.node, b.node AS nbr, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS dist, b.f AS nf FROM n a JOIN n b ON a.graph = b.graph AND a.node <> b.node),
    nr AS (SELECT *, row_number() OVER (PARTITION BY graph, node ORDER BY dist, nbr) AS place FROM nb WHERE dist <= 0.1),
    st0 AS (SELECT graph, coalesce(sum(c) OVER (ORDER BY graph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT graph, count(*) AS c FROM n GROUP BY graph))
    SELECT n.graph, n.node, CAST(g AS INTEGER) AS place, coalesce(nr.nbr, 0) AS nbr, round(coalesce(nr.dist, 1.5), 9) AS dist, nr.nbr IS NULL AS is_pad, round(exp(-pow(coalesce(nr.dist, 1.5) - 5 * CAST(0.2 AS DOUBLE), 2) / {0.2 * 0.2!r}), 8) AS bond_5,
        CAST(start + n.node AS BIGINT) AS global_id, CAST(start + coalesce(nr.nbr, 0) AS BIGINT) AS nbr_global_id, n.f AS own, nr.nf AS other
    FROM n CROSS JOIN range(1, 13) r(g) JOIN st0 ON st0.graph = n.graph LEFT JOIN nr ON nr.graph = n.graph AND nr.node = n.node AND nr.place = g""")
def graph_features(spark: SparkSession, d: str) -> DataFrame:
    """Nodes to padded neighbours with bond filters, features of both ends and ids over all graphs."""
    p = points(spark, d).withColumnRenamed("node", "id")
    p = ranking.with_position(p, ["graph"], ["id"], "node").withColumn("node", F.col("node").cast("int"))
    return _graph_rows(sites.graph_features(written(p), 0.1, 12, 1.5))


def _graph_rows(out: DataFrame) -> DataFrame:
    f = lambda c, i: F.get(c, F.lit(i))
    out = out.select("graph", "node", "place", "nbr", "dist", "is_pad", f("bond", 5).alias("bond_5"), "global_id", "nbr_global_id", f("features", 3).alias("own"), f("nbr_features", 3).alias("other"))
    return rounded(rounded(out, 9, "dist"), 8, "bond_5")


#: A skewed cell of crystals, whose size goes with the graph.
_CRYSTAL = [(0.41, 0.0, 0.0), (0.13, 0.38, 0.0), (-0.09, 0.11, 0.44)]


@query(f"""WITH n AS (SELECT vec_id // 4 AS graph, CAST(vec_id % 4 AS INTEGER) AS node, 1 + (vec_id // 4 % 5) / CAST(10 AS DOUBLE) AS s, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS f FROM embeddings),
    im AS (SELECT {", ".join(f"p * CAST({a} AS DOUBLE) + q * CAST({b} AS DOUBLE) + r * CAST({c} AS DOUBLE) AS d{i}" for i, (a, b, c) in zip("xyz", zip(*_CRYSTAL)))}, p = 0 AND q = 0 AND r = 0 AS home FROM range(-8, 9) p(p), range(-8, 9) q(q), range(-8, 9) r(r)),
    nb AS (SELECT a.graph, a.node, b.node AS nbr, sqrt(pow(b.x + a.s * dx - a.x, 2) + pow(b.y + a.s * dy - a.y, 2) + pow(b.z + a.s * dz - a.z, 2)) AS dist, b.f AS nf FROM n a JOIN n b ON a.graph = b.graph, im WHERE NOT (home AND a.node = b.node)),
    nr AS (SELECT *, row_number() OVER (PARTITION BY graph, node ORDER BY dist, nbr) AS place FROM nb WHERE dist <= 0.5),
    st0 AS (SELECT graph, coalesce(sum(c) OVER (ORDER BY graph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT graph, count(*) AS c FROM n GROUP BY graph))
    SELECT n.graph, n.node, CAST(g AS INTEGER) AS place, coalesce(nr.nbr, 0) AS nbr, round(coalesce(nr.dist, 1.5), 9) AS dist, nr.nbr IS NULL AS is_pad, round(exp(-pow(coalesce(nr.dist, 1.5) - 5 * CAST(0.2 AS DOUBLE), 2) / {0.2 * 0.2!r}), 8) AS bond_5,
        CAST(start + n.node AS BIGINT) AS global_id, CAST(start + coalesce(nr.nbr, 0) AS BIGINT) AS nbr_global_id, n.f AS own, nr.nf AS other
    FROM n CROSS JOIN range(1, 31) r(g) JOIN st0 ON st0.graph = n.graph LEFT JOIN nr ON nr.graph = n.graph AND nr.node = n.node AND nr.place = g""")
def crystal_features(spark: SparkSession, d: str) -> DataFrame:
    """graph_features() of crystals of four sites each, whose cells are smaller than the
    radius: each site has neighbours in several images, its own among them."""
    p = points(spark, d).withColumns({"graph": F.expr("node div 4"), "node": F.col("node") % 4})
    size = 1 + (F.col("graph") % 5) / F.lit(10.0)
    p = p.withColumn("cell", F.array(*[F.array(*[size * c for c in v]) for v in _CRYSTAL]))
    return _graph_rows(sites.graph_features(written(p), 0.5, 30, 1.5, period="cell"))


# ---- features and lookups ----

_SPECIES = "sp AS (SELECT s AS species, [CAST(s % 2 AS DOUBLE), CAST(s % 3 AS DOUBLE), CAST(s AS DOUBLE)] AS features FROM range(1, 46) r(s))"


@query(f"""WITH {_SPECIES}, p AS (SELECT p_partkey, p_size AS species, p_brand FROM part)
    SELECT p_partkey, p.species, sp.features[1] AS f0, sp.features[2] AS f1, sp.features[3] AS f2, CASE WHEN p.species % 5 = 0 THEN 1 ELSE 0 END AS h0, CASE WHEN p.species % 5 = 3 THEN 1 ELSE 0 END AS h3, CAST(q.species AS INTEGER) AS back
    FROM p JOIN sp ON sp.species = p.species JOIN sp q ON q.features = sp.features""")
def feature_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("species").cast("double")
    book = table(spark, d, "part").select(F.col("p_size").alias("species")).distinct().where(F.col("species") <= 45).select("species", F.array(s % 2, s % 3, s).alias("features"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("species"))
    found = sites.species_features(parts, book).withColumn("hot", E.one_hot(F.col("species") % 5, list(range(5))))
    back = sites.species_of(found, book.select(F.col("species").alias("back"), "features"))
    f = lambda c, i: F.get(c, F.lit(i))
    return back.select("p_partkey", "species", f("features", 0).alias("f0"), f("features", 1).alias("f1"), f("features", 2).alias("f2"), f("hot", 0).alias("h0"), f("hot", 3).alias("h3"), "back")


@query("SELECT DISTINCT p_size AS species FROM part WHERE p_size > 45")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_size").alias("species"))
    return sites.missing_species(parts, parts.where(F.col("species") <= 45).distinct())


@query("SELECT CAST(p_partkey AS INTEGER) AS Pixel_Index, round(p_retailprice, 2) AS Ru, CAST(p_size AS DOUBLE) AS Rh, CAST(p_size * 2 AS DOUBLE) AS Pd, CAST(p_size * 3 AS DOUBLE) AS Ir, CAST(p_size * 4 AS DOUBLE) AS Pt FROM part")
def composition_files(spark: SparkSession, d: str) -> DataFrame:
    size, path = F.col("p_size").cast("double"), _scratch(spark)
    df = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("Pixel_Index"), F.round("p_retailprice", 2).alias("Ru"), size.alias("Rh"), (size * 2).alias("Pd"), (size * 3).alias("Ir"), (size * 4).alias("Pt"))
    files.write_csv(df, path, ["Pixel_Index", "Ru", "Rh", "Pd", "Ir", "Pt"])
    return files.read_composition(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, round(c_acctbal, 2) AS target FROM customer")
def target_files(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").cast("string"), F.round("c_acctbal", 2)).write.csv(path)
    return files.read_targets(spark, path)


@query("SELECT id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (SELECT l_linenumber - 1 AS g, CAST(l_quantity AS BIGINT) AS value, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity) - 1 AS id FROM lineitem) GROUP BY id")
def vector_files(spark: SparkSession, d: str) -> DataFrame:
    """A vector per line number, written as a JSON row per cell, read again and added up by position."""
    path = _scratch(spark)
    rows = ranking.with_position(table(spark, d, "lineitem"), ["l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])
    rows = rows.select("l_linenumber", "id", F.col("l_quantity").alias("value"))
    files.write_cells(rows, path)
    found = files.read_cells(spark, path, rows.schema)
    return found.groupBy("id").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


@query("""WITH v AS (SELECT event_id % 16 AS list, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) - 1 AS id, CASE WHEN event_id % 50 <> 7 THEN CAST(floor(value * 1000) AS BIGINT) END AS value FROM events)
    SELECT id, count(*) AS n, count(value) AS n_valid, CAST(sum(value) AS BIGINT) AS total FROM v GROUP BY id""")
def vector_lists(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lists, one in a file, which are read by parts and added up by position."""
    path, e = _scratch(spark), F.col("event_id")
    value = F.when(e % 50 != 7, F.floor(F.col("value") * 1000).cast("double"))
    rows = ranking.with_position(table(spark, d, "events").select((e % 16).alias("list"), "event_id", value.alias("value")), ["list"], ["event_id"])
    files.write_vectors(written(rows), path, "list")
    return files.read_vector(spark, f"{path}/*").groupBy("id").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), F.sum("value").cast("long").alias("total"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag")
def stacked_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select(F.col("event_type").alias("kind"))
    return a.unionByName(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_RAW} SELECT y * 61 + x AS cell, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(value, 4) AS value FROM raw")
def grid_files(spark: SparkSession, d: str) -> DataFrame:
    """A dense grid written as one nested list, read again, cells numbered and told apart by their number."""
    path = _scratch(spark)
    files.write_grid(fields.to_dense(rounded(raw_grid(spark, d), 4, "value"), 61, 61), path)
    cells = files.read_grid(spark, path).select(fields.flatten_index(F.col("y"), F.col("x"), 61).alias("cell"), "value")
    y, x = fields.unflatten_index(F.col("cell"), 61)
    return cells.select("cell", y.alias("y"), x.alias("x"), "value")


@query("SELECT DISTINCT p_size AS species, CAST(p_size % 2 AS DOUBLE) AS f0, CAST(p_size % 3 AS DOUBLE) AS f1, 2 AS width FROM part")
def feature_files(spark: SparkSession, d: str) -> DataFrame:
    """A book of features written as a JSON object and read again."""
    path, s = _scratch(spark), F.col("species")
    files.write_species_features(table(spark, d, "part").select(F.col("p_size").alias("species")).distinct().select("species", F.array(s % 2, s % 3).alias("features")), path)
    f = lambda i: F.get("features", F.lit(i))
    return files.read_species_features(spark, path).select("species", f(0).alias("f0"), f(1).alias("f1"), F.size("features").alias("width"))


@query("SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_linenumber <> 1 THEN 1 END) AS n_valid, round(sum(CASE WHEN l_linenumber <> 1 THEN l_quantity END), 4) AS total FROM lineitem GROUP BY l_orderkey")
def nan_rules(spark: SparkSession, d: str) -> DataFrame:
    """Values that are NaN count as absent."""
    v = E.nan_to_null(F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")))
    out = table(spark, d, "lineitem").select("l_orderkey", v.alias("v")).groupBy("l_orderkey")
    return rounded(out.agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.sum("v").alias("total")), 4, "total")


# Atomic numbers and symbols of the species.
_LABELS = {77: "Ir", 46: "Pd", 78: "Pt", 45: "Rh", 44: "Ru"}


@query("""SELECT p_partkey, s AS label, CASE s WHEN 'Ir' THEN 77 WHEN 'Pd' THEN 46 WHEN 'Pt' THEN 78 WHEN 'Rh' THEN 45 WHEN 'Ru' THEN 44 END AS code
    FROM (SELECT p_partkey, CASE p_size + 30 WHEN 77 THEN 'Ir' WHEN 46 THEN 'Pd' WHEN 78 THEN 'Pt' WHEN 45 THEN 'Rh' WHEN 44 THEN 'Ru' END AS s FROM part)""")
def species_labels(spark: SparkSession, d: str) -> DataFrame:
    """Atomic numbers to symbols and back, null where there is none."""
    label = E.label_of(F.col("p_size") + 30, _LABELS)
    return table(spark, d, "part").select("p_partkey", label.alias("label")).withColumn("code", E.code_of(F.col("label"), _LABELS))


@query("SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 100003, doc_id) - 1 AS position FROM documents")
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The position of each row in an order that follows from its id and nothing else."""
    return ranking.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", order=(F.col("doc_id") * 7919) % 100003)
