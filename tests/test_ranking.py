import glob
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridmeld.operators.metrics import basic_report, bin_trend, error_gain_trend, evaluate, evaluation, hex_bins, joint_min_max, min_max, normaliser, pair_check, quantiles, spearman
from gridmeld.operators.ranking import kendall, pairs_of, shuffled, split_rows, sum_before, top_k_curve, with_position, with_rank, with_ranks


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, truth double, pred double")


@pytest.fixture(scope="module")
def tied():
    r = random.Random(4)
    return [(i, float(r.randrange(12)), float(r.randrange(9))) for i in range(300)]


@pytest.mark.parametrize("method", ["average", "ordinal", "min", "dense"])
def test_two_phase_rank_equals_a_sort(spark, tied, method):
    got = {r["id"]: r["rank"] for r in with_rank(pairs(spark, tied), "truth", method=method, buckets=5).collect()}
    values = sorted(v for _, v, _ in tied)
    order = [i for i, v, _ in sorted(tied, key=lambda t: (t[1], t[0]))]
    for i, v, _ in tied:
        low, n = values.index(v) + 1, values.count(v)
        assert got[i] == {"average": low + (n - 1) / 2, "ordinal": order.index(i) + 1, "min": low, "dense": sorted(set(values)).index(v) + 1}[method]


@pytest.mark.parametrize("buckets", [None, 3, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_within_keys_with_nulls_and_hot_values(spark, buckets, descending):
    """Against a plain sort: nulls last in either direction, as equals; a third of all rows share a value."""
    r = random.Random(3)
    rows = [(i, r.choice([None, "a", "b"]), r.choice([None, 5.0, 5.0, 5.0, *map(float, range(12)), float("nan")])) for i in range(500)]
    methods = ("average", "ordinal", "min", "dense", "size")
    got = {x["id"]: x for x in with_ranks(spark.createDataFrame(rows, "id long, k string, v double"), "v", {m: (m, descending) for m in methods}, ["k"], buckets=buckets).collect()}
    level = lambda v: (v is None, (1 if v != v else 0) * (-1 if descending else 1) if v is not None else 0, (0 if v is None or v != v else -v if descending else v))
    assert len(got) == len(rows)
    for key in (None, "a", "b"):
        mine = sorted((level(v), i) for i, k, v in rows if k == key)
        values = [x for x, _ in mine]
        for place, (x, i) in enumerate(mine, 1):
            low, n = values.index(x) + 1, values.count(x)
            assert tuple(got[i][m] for m in methods) == (low + (n - 1) / 2, place, low, sorted(set(values)).index(x) + 1, len(mine))


def test_ranks_without_keys_keep_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "id long, v double")
    assert {x["id"]: x["rank"] for x in with_rank(df, "v", method="ordinal", buckets=2).collect()} == {1: 1, 3: 2, 2: 3}
    assert with_rank(df.limit(0), "v").count() == 0


def test_kendall_in_chunks_equals_one_chunk(spark, tied):
    df = pairs(spark, tied).selectExpr("*", "id % 2 as g")
    a, b = (sorted(map(str, kendall(df, keys=["g"], per_chunk=n).collect())) for n in (1 << 16, 3))
    assert a == b


def test_numbers_of_pairs_are_whole(spark):
    c = F.lit(5_000_000_001)
    assert spark.range(1).select(pairs_of(c, True)).first()[0] == 5_000_000_001 * 5_000_000_000 // 2
    assert spark.range(1).select(pairs_of(F.lit(7).cast("long"), False)).first()[0] == 21


def test_quantiles_and_sums_before(spark):
    r = random.Random(1)
    v = sorted(r.uniform(0, 9) for _ in range(101))
    df = spark.createDataFrame([(i, x, i % 7) for i, x in enumerate(v)], "id long, v double, n int")
    assert quantiles(df, "v", [0, 0.25, 0.333, 1], tie="id").first()["quantiles"] == pytest.approx([v[0], v[25], v[33] + 0.3 * (v[34] - v[33]), v[100]])
    got = {x["id"]: x["s"] for x in sum_before(df, "id", "n", "s", buckets=6).collect()}
    assert got == {i: sum(k % 7 for k in range(i)) for i in range(101)}


def test_evaluation_agrees_with_its_parts(spark):
    r = random.Random(5)
    rows = [(i, r.random(), r.random(), r.random()) for i in range(200)]
    wide = spark.createDataFrame(rows, "id long, t double, p double, q double")
    report, curve, hexagons = evaluation(wide, "t", {"p": "p", "q": "q"}, (0.1,))
    one = evaluate(wide.selectExpr("'p' as model", "id", "t as truth", "p as pred"), shares=(0.1,)).first()
    mine = report.where("model = 'p'").first()
    assert mine["tau"] == pytest.approx(one["tau"]) and mine["top10_overlap"] == one["top10_overlap"] == curve.where("model = 'p'").first()["overlap"]
    assert hexagons.groupBy("model").sum("n").collect()[0][1] == 200


def test_shuffling_is_an_order_of_all_rows(spark):
    got = {x["id"]: x["position"] for x in shuffled(spark.range(50), "id").collect()}
    assert sorted(got.values()) == list(range(50)) and got != {i: i for i in range(50)}
    assert got == {x["id"]: x["position"] for x in shuffled(spark.range(50).repartition(7), "id").collect()}


def test_kendall_equals_brute_force(spark, tied):
    c = d = tx = ty = both = 0
    for (_, a, p), (_, b, q) in itertools.combinations(tied, 2):
        x, y = (a > b) - (a < b), (p > q) - (p < q)
        c, d, tx, ty, both = c + (x * y > 0), d + (x * y < 0), tx + (x == 0 != y), ty + (y == 0 != x), both + (x == y == 0)
    r = kendall(pairs(spark, tied)).first()
    assert (r["concordant"], r["discordant"], r["tied_x_only"], r["tied_y_only"], r["tied_both"]) == (c, d, tx, ty, both)
    assert r["tau"] == pytest.approx((c - d) / ((c + d + tx) * (c + d + ty)) ** 0.5)


def test_top_k_is_set_overlap(spark, tied):
    got = {r["share"]: (r["k"], r["overlap"]) for r in top_k_curve(pairs(spark, tied), (0.001, 0.05, 0.3, 1.0)).collect()}
    by = lambda c: [t[0] for t in sorted(tied, key=lambda t: (-t[c], t[0]))]
    for share, k in ((0.001, 1), (0.05, 15), (0.3, 90), (1.0, 300)):
        assert got[share] == (k, len(set(by(1)[:k]) & set(by(2)[:k])))


def test_constant_and_non_finite_columns_give_null(spark):
    rows = [(1, 1.0, 2.0), (2, 1.0, 3.0), (3, float("nan"), 1.0), (4, None, 1.0), (5, float("inf"), 1.0)]
    r = basic_report(pairs(spark, rows)).first()
    assert r["n"] == 2 and r["r2"] is None and r["pearson"] is None and r["mae"] == 1.5
    assert spearman(pairs(spark, rows[:2])).first()["spearman"] is None


def test_evaluate_per_model(spark):
    rows = [("m", i, float(i), float(-i)) for i in range(20)]
    r = evaluate(spark.createDataFrame(rows, "model string, id long, truth double, pred double")).first()
    assert r["spearman"] == pytest.approx(-1) and r["tau"] == pytest.approx(-1) and r["top5_overlap"] == 0


def test_scaling_guards_and_invariance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    assert {(r["g"], r["v"]): r["scaled"] for r in min_max(df, "v", ["g"]).collect()} == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("b", 5.0): 5.0}
    assert min_max(df.where("g='b'"), "v", flat="null").first()["scaled"] is None
    r = joint_min_max(spark.createDataFrame([(0.0, 10.0), (5.0, 5.0)], "x double, y double"), ["x", "y"]).collect()
    assert [(q["x_scaled"], q["y_scaled"]) for q in r] == [(0.0, 1.0), (0.5, 0.5)]
    assert normaliser(df.where("g='b'"), "v").first()["std"] is None


def test_bins_collapse_equal_edges_and_drop_small_ones(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(0, 1)] * 6 + [(1, 2), (1, 4), (1, 6)] + [(9, 1)]], "x double, y double")
    got = {(r["low"], r["high"]): (r["n"], r["y_mean"]) for r in bin_trend(df, "x", "y", 4).collect()}
    assert sum(n for n, _ in got.values()) >= 9 and all(n >= 3 for n, _ in got.values())


def test_error_gain(spark):
    df = spark.createDataFrame([(i, 0.0, float(i), 0.0, float(i)) for i in range(12)], "id long, t double, a double, b double, c double")
    rho, bins = error_gain_trend(df, "t", "a", "b", "c", 3)
    assert rho.first()["spearman"] == pytest.approx(-1) and bins.count() == 3


def test_hexagons_count_every_row(spark):
    df = spark.createDataFrame([(float(i % 10), float(i // 10)) for i in range(100)], "x double, y double")
    assert hex_bins(df, "x", "y", 0.0, 10.0).groupBy().sum("n").first()[0] == 100


def test_split_with_no_test_rows_keeps_validation(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long").selectExpr("id", "id as o")
    parts = [r["part"] for r in split_rows(df, "o", "id", 7, 3, 0).orderBy("id").collect()]
    assert parts == ["train"] * 7 + ["val"] * 3


def test_pair_check(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ((1, 2, 3), (2, 3, 4, 5)))
    r = pair_check(a, b).first()
    assert (r["unmatched_left"], r["unmatched_right"]) == (1, 2)
    with pytest.raises(ValueError):
        pair_check(a, b, strict=True)


def test_positions_within_keys_equal_a_sort(spark):
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2]), r.choice([None, *range(40)]), i) for i in range(400)]
    got = {x["v"]: x["id"] for x in with_position(spark.createDataFrame(rows, "k int, o int, v int"), ["k"], ["o", "v"], buckets=7).collect()}
    assert got == {v: p for k in (None, 1, 2) for p, (*_, v) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2])))}


def test_vector_files_hold_no_whole_vector_in_a_row(spark, tmp_path):
    import __spark_entry__

    rows = [(i // 2, 1 + i % 2, i % 7, i % 5, float(i % 50)) for i in range(4000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/gridmeld-*/**/part-*", recursive=True))
    old = files()
    got = {x["id"]: (x["n"], x["total"]) for x in __spark_entry__.queries()["vector_files"](spark, str(tmp_path)).collect()}
    assert got == {i: (2, int(rows[2 * i][4] + rows[2 * i + 1][4])) for i in range(2000)}
    assert max(len(line) for f in files() - old for line in open(f)) < 200
