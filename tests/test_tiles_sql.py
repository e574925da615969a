"""The SQL twin of tiles_of_many_edges where edges are equal."""

from bisect import bisect_right

import duckdb

from gridmeld.plans.registry import ORACLE_SQL


def test_equal_edges_leave_nothing_to_chance():
    """The last of equal edges counts, as in tiles_by_table(); an ASOF join alone takes any of them."""
    c = duckdb.connect()
    c.execute("CREATE TABLE orders AS SELECT i * 5 AS o_orderkey, CAST((i * 7919) % 25000 AS DOUBLE) * 4 AS o_totalprice FROM range(180000) r(i)")
    c.execute("CREATE TABLE lineitem AS SELECT CASE i % 2 WHEN 0 THEN 'F' ELSE 'O' END AS l_linestatus, CAST(i // 2 AS DOUBLE) AS l_extendedprice FROM range(60000) r(i)")
    edges = {m: sorted((i * 7919) % 25000 * (1.0 if m == "F" else 2.0) for i in range(180000)) for m in "FO"}
    want = {}
    for i in range(60000):
        m, v = "FO"[i % 2], float(i // 2)
        tile = bisect_right(edges[m], v) - 1 if v < edges[m][-1] else None
        want[m, tile] = want.get((m, tile), 0) + 1
    assert {(m, t): n for m, t, n in c.execute(ORACLE_SQL["tiles_of_many_edges"]).fetchall()} == want
