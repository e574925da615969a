import math
import random

import pytest
from pyspark.sql import functions as F

from gridmeld.functions import expressions as E
from gridmeld.operators import fields, sites
from gridmeld.plans import registry
from gridmeld.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_a_shifted_patch_is_found(spark):
    raw = spark.range(400).select((F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("value"))
    target = fields.cut(raw, 4, 7, 10, 10)
    lo, hi = target.agg(F.min("value"), F.max("value")).first()
    target = target.withColumn("value", (F.col("value") - lo) / (hi - lo))
    best = fields.best_offset(fields.offset_errors(raw, target, 10, 10)).first()
    assert (best["dy"], best["dx"]) == (4, 7) and best["diff"] == pytest.approx(0, abs=1e-12)


def test_two_maps_are_aligned_in_one_job(spark):
    """Each map has its own best offset, is masked by its own cells, and brings followers and composition along."""
    n = lambda m: F.pmod(F.hash("id", F.lit(m)), F.lit(1000)).cast("double")
    base = spark.range(400).select((F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), n(1).alias("a"), n(2).alias("b"))
    raw = base.select(F.lit("a").alias("m"), "y", "x", F.col("a").alias("value")).unionByName(base.select(F.lit("b").alias("m"), "y", "x", F.col("b").alias("value")))
    part = lambda m, y, x: fields.cut(raw.where(F.col("m") == m), y, x, 8, 8)
    target = part("a", 3, 5).where("y != 2").unionByName(part("b", 6, 1).where("x != 0"))
    target = fields.min_max(target, "value", ["m"]).select("m", "y", "x", F.col("scaled").alias("value"))
    best = {r["m"]: (r["dy"], r["dx"], r["diff"]) for r in fields.best_offset(fields.offset_errors(raw, target, 10, 10, ["m"]), ["m"]).collect()}
    assert {m: v[:2] for m, v in best.items()} == {"a": (3, 5), "b": (6, 1)} and max(v[2] for v in best.values()) < 1e-12
    out = fields.align_fields(raw, target, {"other": raw.withColumn("value", 3 - 2 * F.col("value"))}, raw.select("m", "y", "x", F.col("value").alias("e0")), 10, 10, 8, 20, ["m"])
    rows = out.collect()
    assert sum(r["m"] == "a" for r in rows) == 56 and sum(r["m"] == "b" for r in rows) == 56
    want = {(r["m"], r["y"], r["x"]): r["value"] for r in target.collect()}
    values = {(r["m"], r["y"], r["x"]): r["value"] for r in raw.collect()}
    for r in rows:
        assert r["scaled"] == pytest.approx(want[r["m"], r["y"], r["x"]]) and r["other"] == pytest.approx(1 - r["scaled"])
        assert r["e0"] == values[r["m"], r["y"] + r["dy"], r["x"] + r["dx"]] and r["local_index"] == r["y"] * 8 + r["x"] and r["global_index"] == (r["y"] + r["dy"]) * 20 + r["x"] + r["dx"]


def test_grids_of_several_maps(spark):
    g = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 1, 1, 2.0)], "m string, y int, x int, value double")
    dense = fields.to_dense(g, 2, 2, keys=["m"]).collect()
    assert len(dense) == 8 and {(r["m"], r["y"], r["x"]) for r in dense if r["value"] is not None} == {("a", 0, 0), ("b", 1, 1)}
    tiles = fields.tile_means(g, 2, 2, (0.0, 2.0), (0.0, 2.0), ["value"], 1.0, ["m"]).collect()
    assert {(r["m"], r["y"], r["x"], r["value"]) for r in tiles} == {("a", 0, 0, 1.0), ("b", 1, 1, 2.0)}


def test_activity_field_of_known_colours(spark):
    palette = spark.createDataFrame([(0, 0.0, [0.1, 0.5]), (1, 5.0, [0.8, 0.2])], "idx int, value double, code array<double>")
    rows = [(y, x, 255 * c[0], 255 * c[1]) for y in range(4) for x in range(4) for c in [(0.1, 0.5) if y < 2 else (0.8, 0.2) if x < 2 else (0.99, 0.99)]]
    got = fields.activity_field(spark.createDataFrame(rows, "y int, x int, r double, g double"), palette, 2, 2, (0.0, 4.0), (0.0, 4.0), ["r", "g"]).collect()
    assert {(r["y"], r["x"]): r["value"] for r in got} == {(1, 0): 0.0, (1, 1): 0.0, (0, 0): 1.0, (0, 1): None}


def test_compositions_fill_all_sites(spark):
    table = spark.createDataFrame([(1, 0.3, 0.7), (2, 1.0, 0.0)], "config long, a double, b double")
    got = sites.sites_of(table, ["a", "b"], registry.lattice(spark).withColumnRenamed("node", "site"), F.xxhash64("config", "site")).groupBy("config", "species").count().collect()
    assert {(r["config"], r["species"]): r["count"] for r in got} == {(1, 0): 153, (1, 1): 359, (2, 0): 512}


def test_grid_reshaping(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (1, 2, float("nan"))], "y int, x int, value double")
    assert fields.present(g).count() == 1
    assert fields.embed(fields.present(g), 3, 3, 1, 1, 9.0).where("value = 1.0").select("y", "x").first() == (1, 1)
    assert fields.to_dense(g, 2, 3).count() == 6
    assert fields.flip(g, 2).where("x = 0").first()["y"] == 1


def test_background_rules(spark):
    rows = [(0, 0, 0.95, 0.95, 0.95, 1.0), (0, 1, 0.0, 0.0, 0.0, 0.0), (49, 0, 0.5, 0.5, 0.5, 1.0), (1, 1, 0.5, 0.95, 0.95, 1.0)]
    assert fields.background(spark.createDataFrame(rows, "y int, x int, r double, g double, b double, a double")).count() == 1


def test_nearest_code_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.0],)], "v array<double>")
    codes = spark.createDataFrame([(2, [1.0]), (1, [-1.0])], "idx int, code array<double>")
    assert fields.nearest_code(df, codes, "v").first()["idx"] == 1


def test_apportion_fills_up_with_the_last(spark):
    assert one(spark, *E.apportion([F.lit(x) for x in (0.3, 0.3, 0.4)])) == (153, 153, 206)
    assert one(spark, *E.apportion([F.lit(0.0), F.lit(0.0)])) == (0, 0)


def test_scalar_forms(spark):
    assert one(spark, F.size(E.radial_basis(F.lit(1.0))))[0] == 41
    assert one(spark, E.edges(0, 5, 2)) == ([0, 2, 5],)
    assert one(spark, E.sigmoid(F.lit(-800.0)), E.softplus(F.lit(800.0))) == (0.0, 800.0)
    assert one(spark, E.acceptance(F.lit(0.0), F.lit(-1.0), F.lit(300.0)))[0] == 1.0
    assert one(spark, E.cooling(F.lit(0), 10), E.cooling(F.lit(9), 10)) == pytest.approx((3629.8, 298.0))
    assert one(spark, E.lut_index(F.lit(1.5)), E.lut_index(F.lit(-1.0)), E.lut_index(F.lit(0.5))) == (255, 0, 128)
    assert one(spark, E.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))[0] == 11.0
    assert one(spark, E.finite(F.lit(float("nan"))), E.finite(F.lit(1.0))) == (False, True)


def test_lattice_has_the_known_neighbours(spark):
    counts = [r["count"] for r in registry.lattice_edges(spark).groupBy("node").count().collect()]
    assert sorted(set(counts)) == [9, 12] and counts.count(9) == 128


def test_pure_slabs_have_the_known_binding(spark):
    for kind, energy in enumerate((0.625, 1.076, 1.081, 0.657, 0.281)):
        row = {f"z{z}_{s}": n if s == kind else 0 for z, n in ((1, 1), (2, 6), (3, 3)) for s in range(5)}
        assert sites.linear_score(spark.createDataFrame([row]), registry._COEFFICIENTS).first()["energy"] == pytest.approx(energy)


def test_pure_slab_activity(spark):
    scored = spark.createDataFrame([(0, 0.625)] * 4, "config int, energy double")
    assert sites.boltzmann(scored).first()["activity"] == pytest.approx(18.942044, abs=1e-4)
    far = spark.createDataFrame([(0, 300.0)], "config int, energy double")
    assert math.isfinite(sites.boltzmann(far).first()["activity"])


def test_radius_join_equals_all_pairs(spark):
    rows = [(0, i, math.sin(i) * 2, math.cos(i * 1.7) * 2, math.sin(i * 0.3)) for i in range(60)]
    df = spark.createDataFrame(rows, "graph int, node int, x double, y double, z double")
    got = {(r["node"], r["nbr"]) for r in sites.neighbours(df, 0.8).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a is not b and math.dist(a[2:], b[2:]) <= 0.8}


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_nearest_within_equals_all_pairs(spark, spread):
    r = random.Random(3)
    # whole 64ths, so that sums of squares are exact and equal distances are ties
    rows = [(g, i, *[round(r.gauss(0, spread) * 64) / 64 for _ in range(3)]) for g in (0, 1) for i in range(120)] + [(2, 0, 0.0, 0.0, 0.0), (2, 1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "graph int, node int, x double, y double, z double")
    want = set()
    for g, i, *a in rows:
        near = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b))), j) for h, j, *b in rows if h == g and j != i and None not in (*a, *b))
        want |= {(g, i, j, round(d, 9)) for d, j in [x for x in near if x[0] <= 1.0][:4]}
    got = [(e["graph"], e["node"], e["nbr"], round(e["dist"], 9)) for e in sites.nearest_within(df, 1.0, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sites.nearest_within(df.limit(0), 1.0, 4).count() == 0


def test_short_neighbour_lists_are_padded(spark):
    nodes = spark.createDataFrame([(0, 0), (0, 1)], "graph int, node int")
    edges = spark.createDataFrame([(0, 0, 1, 0.5)], "graph int, node int, nbr int, dist double")
    got = sites.nearest_padded(edges, nodes, 3, 9.0).collect()
    assert len(got) == 6 and sum(r["is_pad"] for r in got) == 5 and max(r["dist"] for r in got) == 9.0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "v.json").write_text("[1.5, null, NaN, 2]")
    assert [r["value"] for r in files.read_vector(spark, str(tmp_path / "v.json")).orderBy("id").collect()] == [1.5, None, None, 2.0]
    (tmp_path / "g.json").write_text("[[1, NaN], [null, 4]]")
    assert {(r["y"], r["x"], r["value"]) for r in files.read_grid(spark, str(tmp_path / "g.json")).collect()} == {(0, 0, 1.0), (1, 1, 4.0)}
    (tmp_path / "s.json").write_text('{"1": [0, 1], "2": [1, 1]}')
    assert {(r["species"], tuple(r["features"])) for r in files.read_species_features(spark, str(tmp_path / "s.json")).collect()} == {(1, (0.0, 1.0)), (2, (1.0, 1.0))}
    (tmp_path / "t.csv").write_text("a,1.5\nb,2\n")
    assert files.read_targets(spark, str(tmp_path / "t.csv")).count() == 2


def test_tasks_of_zone_counts_grow_in_number_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(sites, "PER_PART", 100)
    zoned = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 2, 3)], "node int, nbr int, zone int")
    species = spark.range(3000).select((F.col("id") / 10).cast("int").alias("config"), (F.col("id") % 10).cast("int").alias("site"), (F.col("id") % 3).cast("int").alias("species"))
    out = sites.zone_counts(zoned, species, range(3))
    assert out.rdd.getNumPartitions() == 10  # 900 of 3,000 rows are in a zone
    got = {(x["config"], x["node"]): x for x in out.collect()}
    assert len(got) == 600
    for c in range(300):
        kind = [(c * 10 + s) % 3 for s in range(3)]
        assert all(got[c, 0][f"z{z}_{s}"] == ((z, s) in ((1, kind[0]), (2, kind[1]))) for z in (1, 2, 3) for s in range(3))
        assert all(got[c, 1][f"z{z}_{s}"] == ((z, s) in ((1, kind[1]), (3, kind[2]))) for z in (1, 2, 3) for s in range(3))
