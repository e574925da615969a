"""Periodic neighbours and full bins against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridmeld.operators import sites

SCHEMA = "graph long, node int, x double, y double, z double"


def plain(points, radius, period, reach):
    """(graph, node, nbr, dist rounded) -> count, by all images up to `reach` steps."""
    out = Counter()
    for g, i, *p in points:
        for h, j, *q in points:
            if g != h:
                continue
            for steps in itertools.product(*[range(-reach, reach + 1)] * len(period)):
                if i == j and not any(steps):
                    continue
                d = math.dist(p, [c + sum(n * v[k] for n, v in zip(steps, period)) for k, c in enumerate(q)])
                if d <= radius:
                    out[g, i, j, round(d, 6)] += 1
    return out


def found(rows):
    return Counter((r["graph"], r["node"], r["nbr"], round(r["dist"], 6)) for r in rows.collect())


def cloud(r, graphs, nodes, spread):
    return [(g, n, *(r.uniform(-spread, spread) for _ in range(3))) for g in range(graphs) for n in range(nodes)]


@pytest.mark.parametrize(
    "period",
    [
        [(0.7, 0.0, 0.0)],
        [(0.2, 0.9, 0.1)],
        [(0.9, 0.0, 0.0), (0.7, 0.5, 0.0)],
        [(0.6, 0.1, 0.2), (0.0, 0.8, -0.3)],
        [(0.9, 0.0, 0.0), (0.8, 0.6, 0.0), (-0.4, 0.3, 0.7)],
    ],
)
def test_images_as_many_as_the_radius_reaches(spark, period):
    points = cloud(random.Random(len(period)), 2, 5, 2.0)
    df = spark.createDataFrame(points, SCHEMA)
    want = plain(points, 1.6, period, 13)
    assert found(sites.neighbours(df, 1.6, period=period)) == want and sum(want.values()) >= 30


def test_a_cell_much_smaller_than_the_radius(spark):
    """One site in a cubic cell of 1: all lattice points within 2.5, of which there are 80."""
    df = spark.createDataFrame([(0, 0, 0.25, 7.5, -3.25)], SCHEMA)
    cell = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    got = sites.neighbours(df, 2.5, period=cell).collect()
    assert len(got) == 80 and Counter(round(r["dist"] ** 2) for r in got) == {1: 6, 2: 12, 3: 8, 4: 6, 5: 24, 6: 24}
    near = sites.nearest_padded(sites.nearest_within(df, 2.5, 12, period=cell), df, 12, 9.0).orderBy("place").collect()
    assert [round(r["dist"], 9) for r in near] == [1.0] * 6 + [round(2**0.5, 9)] * 6 and not any(r["is_pad"] for r in near)


def test_cells_in_a_column_and_the_nearest_of_each(spark):
    r = random.Random(3)
    cells = {g: [[0.5 + 0.1 * g, 0.0, 0.0], [0.2, 0.4, 0.05], [0.1, -0.1, 0.6]] for g in range(3)}
    points = cloud(r, 3, 4, 1.0)
    df = spark.createDataFrame([(*p, cells[p[0]]) for p in points], SCHEMA + ", cell array<array<double>>").withColumn("home", F.lit(1))
    want = Counter()
    for g, cell in cells.items():
        want += plain([p for p in points if p[0] == g], 0.91, cell, 8)
    assert found(sites.neighbours(df, 0.91, period="cell")) == want
    for most in (3, 500):
        near = sites.nearest_within(df, 0.91, most, period="cell").collect()
        for g, i, *_ in points:
            whole = sorted(d for (h, n, _, d), c in want.items() for _ in range(c) if (h, n) == (g, i))
            assert sorted(round(x["dist"], 6) for x in near if (x["graph"], x["node"]) == (g, i)) == whole[:most]
    slab = Counter()
    for g, cell in cells.items():
        slab += plain([p for p in points if p[0] == g], 0.91, cell[:2], 9)
    assert found(sites.neighbours(df, 0.91, period="cell", periodic=(True, True, False))) == slab
    assert sites.neighbours(df.limit(0), 0.91, period="cell").count() == 0


def test_full_bins_are_dealt_to_tasks(spark, monkeypatch):
    """Half of all sites stand in one bin; none of its pairs is lost, and they come from several tasks."""
    r = random.Random(4)
    points = [(0, n, *(0.1 + r.random() / 10 if n % 2 else r.uniform(0, 9) for _ in range(3))) for n in range(120)]
    df = spark.createDataFrame(points, SCHEMA)
    want = plain(points, 1.0, [], 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(sites.neighbours(df, 1.0)) == want
        monkeypatch.setattr(sites, "PER_BIN", 8)
        out = sites.neighbours(df, 1.0)
        assert found(out) == want
        tasks = [x["count"] for x in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(tasks) == 4 and max(tasks) < 0.6 * sum(tasks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crystal_features_have_both_ends_of_images(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, [1.0]), (0, 1, 0.5, 0.5, 0.5, [2.0]), (1, 0, 5.0, 5.0, 5.0, [3.0])], SCHEMA + ", features array<double>")
    rows = sites.graph_features(df, 1.1, 16, 2.1, period=[(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]).orderBy("graph", "node", "place").collect()
    own = [r for r in rows if (r["graph"], r["node"]) == (0, 0)]
    assert [r["nbr"] for r in own[:8]] == [1] * 8 and [r["nbr"] for r in own[8:14]] == [0] * 6 and [r["is_pad"] for r in own[14:]] == [True] * 2
    assert {tuple(r["nbr_features"]) for r in own[:8]} == {(2.0,)} and {r["nbr_global_id"] for r in own[:8]} == {1} and own[15]["dist"] == 2.1
    assert [r["nbr_global_id"] for r in rows if r["graph"] == 1] == [2] * 16
