"""Edges in a table against a plain search."""

import random
from bisect import bisect_right

from gridmeld.operators import fields


def test_edges_that_differ_from_map_to_map(spark):
    r = random.Random(5)
    edges = {"a": sorted(r.choice([r.uniform(0, 1), r.uniform(0, 1e6), float(r.randrange(5))]) for _ in range(400)), None: [0.0, 1.0, 1.0, 3.0], "one": [2.0], "same": [2.0, 2.0]}
    rows = [(i, m, r.choice([None, r.uniform(-1, 2), r.uniform(0, 1.1e6), float(r.randrange(6)), edges["a"][r.randrange(400)]])) for i, m in enumerate(r.choices([*edges, "none"], k=900))]
    df = spark.createDataFrame(rows, "id long, m string, v double")
    table = spark.createDataFrame([(m, e) for m, es in edges.items() for e in es] + [("a", None)], "m string, edge double")
    got = {x["id"]: x["tile"] for x in fields.tiles_by_table(df, "v", table, ["m"]).collect()}
    for i, m, v in rows:
        es = edges.get(m, [])
        want = bisect_right(es, v) - 1 if es and v is not None and es[0] <= v < es[-1] else None
        assert got[i] == want, (m, v)
    assert len(got) == 900 and fields.tiles_by_table(df.limit(0), "v", table, ["m"]).count() == 0
