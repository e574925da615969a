"""JSON lists and grids read by parts equal those read whole."""

import json
import random

import pytest

from gridmeld.sources import files


@pytest.fixture(params=["200", "4000", "134217728"])
def cut(spark, request):
    """The sizes of the parts that files are split in."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield int(request.param)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def absent(x):
    return None if x is None or x != x else x


def test_a_list_is_read_by_several_tasks(spark, tmp_path, cut):
    r = random.Random(1)
    lists = [[r.choice([None, float("nan"), r.random(), float(r.randrange(99))]) for _ in range(n)] for n in (2500, 40, 1, 0)]
    for i, x in enumerate(lists):
        (tmp_path / f"v{i}.json").write_text(json.dumps(x, indent=r.choice([None, 1])))
    got = files.read_vector(spark, str(tmp_path))
    want = sorted((i, str(absent(v))) for x in lists for i, v in enumerate(x))
    assert sorted((x["id"], str(x["value"])) for x in got.collect()) == want
    if cut == 200:
        rows, blocks = files._items(spark, str(tmp_path / "v0.json"))
        assert blocks.count() > 20 and blocks.agg({"n": "max"}).first()[0] < 100
    one = files.read_vector(spark, str(tmp_path / "v0.json")).orderBy("id").collect()
    assert [x["value"] for x in one] == [absent(v) for v in lists[0]]


def test_a_grid_is_read_by_several_tasks(spark, tmp_path, cut):
    r = random.Random(2)
    grids = [[[r.choice([None, float("nan"), r.random()]) for _ in range(r.choice([0, 1, 7, 300]))] for _ in range(40)], [[1.0, 2.0], [3.0]], [[]], []]
    for i, g in enumerate(grids):
        (tmp_path / f"g{i}.json").write_text(json.dumps(g))
    got = files.read_grid(spark, str(tmp_path))
    want = sorted((y, x, v) for g in grids for y, row in enumerate(g) for x, v in enumerate(row) if absent(v) is not None)
    assert sorted(tuple(x) for x in got.collect()) == want and dict(got.dtypes) == {"y": "int", "x": "int", "value": "double"}


def test_lists_of_each_key_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.5), ("a", 1, None), ("b", 0, float("nan")), ("a", 2, -2.0)], "k string, id long, value double")
    files.write_vectors(df, str(tmp_path / "out"), "k")
    text = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").glob("k=*/*.txt")}
    assert text == {"k=a": [1.5, None, -2.0], "k=b": [None]}
