"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges from which nodes with very many neighbours are looked for, the edges that make one such, and the parts it is dealt to.
HUB_EDGES, PARTS = 5_000_000, 256


def _with_least(both: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """Each edge (u, v) with w = u and the least node m of u's neighbourhood.

    A node in at least HUB_EDGES edges goes to PARTS tasks: its edges by the hash of
    their other end, its row of `least` to each of them. There are at most twice
    n_edges / HUB_EDGES such nodes, and none in a table with fewer edges, which so
    needs no look at the degrees.
    """
    if n_edges < HUB_EDGES:
        return both.join(least, both.u == least.w)
    hubs = least.where(F.col("degree") >= HUB_EDGES).select(F.col("w").alias("hub"))
    dealt = both.join(hubs, both.u == hubs.hub, "left").withColumn("part", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")).drop("hub")
    parts = F.explode(F.when(F.col("degree") >= HUB_EDGES, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    least = least.select("w", "m", parts.alias("p"))
    return dealt.join(least, (dealt.u == least.w) & (dealt.part == least.p))


def _stars(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One step: hangs neighbours on the least node of each neighbourhood.

    The least neighbour is an aggregate with partial sums and comes back by a join
    that deals nodes with very many neighbours to many tasks.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "degree")
    near = _with_least(both, least, n_edges)
    if large:
        out = near.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the least
    node that can be reached. An edge table without rows gives none.

    Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Only a count and a checksum come to the driver.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    check = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = check(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = written(_stars(_stars(now, True, seen[0]), False, seen[0]), "edges")
        was, seen = seen, check(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
