"""Large groups spread over tasks: Kendall with few values, trajectories, scaling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeld.operators import metrics, ranking


def plain_kendall(rows):
    c = d = tx = ty = both = 0
    for i, (x, y) in enumerate(rows):
        for a, b in rows[:i]:
            s = (x - a) * (y - b)
            c, d = c + (s > 0), d + (s < 0)
            tx, ty, both = tx + (x == a and y != b), ty + (x != a and y == b), both + (x == a and y == b)
    return c, d, tx, ty, both


@pytest.mark.parametrize("kinds", [1, 2, 50, 10**6])
def test_kendall_with_few_values_of_either_side(spark, kinds):
    r = random.Random(kinds)
    rows = [(r.randrange(10**6), r.randrange(kinds)) for _ in range(250)]
    rows += [(5, 7)] * 40  # one pair of values very often
    for turned in (rows, [(y, x) for x, y in rows]):
        df = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(turned)] + [(None, i, float(i), float(-i)) for i in range(5)] + [("a", 999, None, 1.0)], "g string, id long, truth double, pred double")
        for chunk in (10**6, 9):
            got = {x["g"]: x for x in ranking.kendall(df, keys=["g"], per_chunk=chunk).collect()}
            names = ("concordant", "discordant", "tied_x_only", "tied_y_only", "tied_both")
            assert tuple(int(got["a"][n]) for n in names) == plain_kendall(turned) and got[None]["tau"] == -1.0


def test_kendall_sorts_no_more_rows_than_a_block_has_values(spark, tmp_path):
    """With 50 distinct predictions the windows see 50 rows of a block, not all of them."""
    df = spark.range(20_000).select("id", F.xxhash64("id").cast("double").alias("truth"), (F.col("id") % 50).cast("double").alias("pred"))
    cells = ranking.written(ranking.with_rank(ranking.written(df.select(F.col("truth").alias("x"), F.col("pred").alias("ry"), F.lit(1).cast("long").alias("c"))), "x", "rx", (), "min", "ry").select("rx", "ry", "c"))
    out = ranking.kendall_of(cells)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("Window") :]
    assert "Aggregate" in before[: before.index("Relation")]  # what a window reads is added up per value before
    r = out.first()
    assert r["n"] == 20_000 and r["concordant"] + r["discordant"] + r["tied_y_only"] == 20_000 * 19_999 // 2


def plain_carry(rows):
    out, last = {}, {}
    for key, t, i, v, ok in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        if ok and v is not None:
            last[key] = v
        out[i] = last.get(key)
    return out


def test_one_long_trajectory_is_many_tasks_work(spark):
    r = random.Random(7)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, 5, 5, 5, *range(60)]), i, r.choice([None, r.random()]), r.random() < 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "run long, t int, id long, v double, ok boolean").repartition(5)
    for buckets in (1, 7, 40):
        got = metrics.carry_forward(df, ["run"], ["t", "id"], "v", "ok", buckets=buckets)
        assert {x["id"]: x["carried"] for x in got.collect()} == plain_carry(rows) and got.columns == [*df.columns, "carried"]
    one = df.where("run = 1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [x["count"] for x in metrics.carry_forward(one, ["run"], ["t", "id"], "v", "ok", buckets=40).groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) == 4 and max(tasks) < 0.6 * sum(tasks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert metrics.carry_forward(df.limit(0), ["run"], ["t", "id"], "v", "ok").count() == 0


def test_groups_are_scaled_without_a_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 5.0), ("b", None)], "g string, v double")
    out = metrics.min_max(df, "v", ["g"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(x["g"], x["v"]): x["scaled"] for x in out.collect()} == {("a", 1.0): 0.0, ("a", 3.0): 1.0, (None, 5.0): 5.0, ("b", None): None}


@pytest.mark.parametrize("kind", ["spread", "hot", "few"])
def test_ranges_are_cut_again_when_there_are_many(spark, monkeypatch, kind):
    """With more ranges than one level has, no (range, part) holds many rows, and ranks stay those of one sort."""
    monkeypatch.setattr(ranking, "MOST_RANGES", 6)
    monkeypatch.setattr(ranking, "PER_RANGE", 30)
    r = random.Random(3)
    draw = {"spread": lambda: r.gauss(0, 1), "hot": lambda: r.choice([0.5, 0.5, r.random()]), "few": lambda: float(r.randrange(3))}[kind]
    rows = [(i, None if r.random() < 0.02 else draw()) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(3)
    *cuts, n = ranking.range_cuts(df, ["v", "id"])
    parts = [x["count"] for x in ranking.ranged(df, "v", "id", *cuts).groupBy("__b", "__s").count().collect()]
    assert n == 900 and len(cuts[1]) > 6 and max(parts) <= 100
    known = sorted((v, i) for i, v in rows if v is not None)
    order = [i for _, i in known] + sorted(i for i, v in rows if v is None)
    names = {"ordinal": ("ordinal", False), "average": ("average", False), "dense": ("dense", False)}
    got = {x["id"]: x for x in ranking.with_ranks(df, "v", names).collect()}
    values = [v for v, _ in known]
    for place, i in enumerate(order, 1):
        v = dict(rows)[i]
        if v is not None:
            assert got[i]["ordinal"] == place and got[i]["average"] == values.index(v) + 1 + (values.count(v) - 1) / 2 and got[i]["dense"] == sorted(set(values)).index(v) + 1
    assert {x["id"]: x["p"] for x in ranking.with_position(df, [], ["id"], "p").collect()} == {i: i for i, _ in rows}
    assert {x["id"]: x["s"] for x in ranking.sum_before(df, "id", "id", "s").collect()} == {i: sum(range(i)) for i, _ in rows}
    pairs = df.where("v is not null").select("id", F.col("v").alias("truth"), (F.col("id") * 7919 % 1009).cast("double").alias("pred"))
    plain = [(v, float(i * 7919 % 1009)) for i, v in rows if v is not None]
    assert int(ranking.kendall(pairs, per_chunk=20).first()["concordant"]) == plain_kendall(plain)[0]


def test_kendall_does_not_multiply_rows(spark):
    df = spark.range(2_000).select("id", F.xxhash64("id").cast("double").alias("truth"), F.xxhash64("id", "id").cast("double").alias("pred"))
    out = ranking.kendall(df, per_chunk=100)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = random.Random(2)
    u, v = ([r.randrange(30) for _ in range(120)] for _ in range(2))
    c = [r.randrange(1, 1 << 40) for _ in u]
    want = sum(a * b for i, a in enumerate(c) for j, b in enumerate(c) if u[i] < u[j] and v[i] < v[j])
    assert ranking.rising_pairs(np.array(u), np.array(v), np.array(c, dtype=object)) == want  # beyond 64 bits
