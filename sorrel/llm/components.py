"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.workspace import Workspace


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't its component's smallest node.

    Each half step sends every edge to the smallest neighbour of one of its ends. The minima are
    partial aggregates, so a hub costs one row per task; the join that follows is between two
    written tables, so Spark can split a hub's edges over many tasks. Nothing is gathered in a
    group or on the driver but a count and a checksum a round. Null ends, loops and repeated
    edges are ignored; an empty table gives an empty result.
    """
    cur = ws.table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges-0",
    )
    seen = None
    for k in range(1, max_rounds + 1):
        # Large star: each edge's upper end moves to the least neighbour of its lower end.
        both = cur.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(cur.select(F.col("lo").alias("n"), F.col("lo").alias("m")))
        least = ws.table(both.groupBy("n").agg(F.min("m").alias("m")), f"least-{k}")
        large = ws.table(cur.join(least, cur.lo == least.n).select("hi", F.col("m").alias("lo")).distinct(), f"large-{k}")
        # Small star: all lower neighbours of a node move to the least of them.
        low = ws.table(large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m")), f"low-{k}")
        moved = large.join(low, large.hi == low.n).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        nxt = ws.table(moved.union(low.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct(), f"edges-{k}")
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        for name in (f"edges-{k - 1}", f"least-{k}", f"large-{k}", f"low-{k}"):
            ws.drop(name)
        cur = nxt
        if tuple(now) == seen or not now["n"]:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
