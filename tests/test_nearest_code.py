"""The nearest codeword by the grid of a large book against all comparisons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridmeld.operators import fields


def plain(v, codes):
    if v is None or any(x is None or x != x for x in v):
        return None
    return min((round(math.dist(v, c), 9), i) for i, c in codes if c is not None)[1]


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_grid_equals_all_comparisons(spark, monkeypatch, dims):
    r = random.Random(dims)
    monkeypatch.setattr(fields, "SMALL_BOOK", 10)
    close = [5 + r.random() / 1000 for _ in range(dims)]
    codes = [(i, [r.choice([r.uniform(0, 9), float(r.randrange(9))]) for _ in range(dims)] if i % 2 else [x + r.random() / 1000 for x in close]) for i in range(300)]
    codes += [(500 + i, list(codes[i][1])) for i in range(50)] + [(7000, None)]  # repeated codes, the smaller id wins
    rows = [[float(r.randrange(9)) if r.random() < 0.5 else r.uniform(-1, 10) for _ in range(dims)] for _ in range(150)]
    rows += [[x + r.random() / 1000 for x in close] for _ in range(50)] + [[1e6] * dims, [-300.0] + [4.0] * (dims - 1), None, [None] + [1.0] * (dims - 1), [float("nan")] * dims, list(codes[1][1])]
    rows += rows[:20]
    df = spark.createDataFrame([(i, v, "own") for i, v in enumerate(rows)], "id long, v array<double>, dist string")
    book = spark.createDataFrame(codes, "idx long, code array<double>")
    got = fields.nearest_code(df, book, "v").collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["idx"] == plain(x["v"], codes), x
    monkeypatch.setattr(fields, "SMALL_BOOK", 10_000)
    assert {x["id"]: x["idx"] for x in fields.nearest_code(df, book, "v").collect()} == {x["id"]: x["idx"] for x in got}


def test_a_hundred_thousand_codes_without_a_broadcast(spark):
    n = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    book = spark.range(100_000).select(F.col("id").alias("idx"), F.array(n(1), n(2), n(3)).alias("code"))
    df = spark.range(300).select("id", F.array(n(4), n(5), n(6)).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fields.nearest_code(df, book, "v")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    codes = [(x["idx"], x["code"]) for x in book.collect()]
    for x in got[:40]:
        assert x["idx"] == plain(x["v"], codes)


def test_books_without_codes(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    none = spark.createDataFrame([], "idx long, code array<double>")
    assert [x["idx"] for x in fields.nearest_code(df, none, "v").collect()] == [None]
    assert fields.nearest_code(df.limit(0), spark.createDataFrame([(1, [1.0])], "idx long, code array<double>"), "v").count() == 0


def test_absent_targets_do_not_count(spark):
    raw = spark.createDataFrame([(y, x, float(y * 7 + x * x)) for y in range(6) for x in range(6)], "y int, x int, value double")
    target = spark.createDataFrame([(0, 0, 0.0), (0, 1, None), (1, 1, 1.0), (1, 0, float("nan"))], "y int, x int, value double")
    got = fields.offset_errors(raw, target, 2, 2)
    assert {x["n_valid"] for x in got.collect()} == {2} and got.where("diff is null").count() == 0


def test_a_book_that_is_small_on_disk_is_not_broadcast(spark, monkeypatch):
    """Written codes take few bytes a row, so that sizes on disk would let a large book through Spark's limit."""
    monkeypatch.setattr(fields, "SMALL_BOOK", 10)
    book = spark.range(3_000).select(F.col("id").alias("idx"), F.array((F.col("id") % 30).cast("double"), (F.col("id") % 50).cast("double"), F.lit(1.0)).alias("code"))
    df = spark.range(40).select("id", F.array((F.col("id") * 7 % 33).cast("double"), (F.col("id") * 11 % 53).cast("double"), F.lit(2.0)).alias("v"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    out = fields.nearest_code(df, book, "v")
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    codes = [(x["idx"], x["code"]) for x in book.collect()]
    assert all(x["idx"] == plain(x["v"], codes) for x in out.collect())
