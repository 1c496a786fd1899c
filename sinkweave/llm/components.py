"""Connected components of an edge table, by alternating large-star and small-star rounds.

Both steps rewrite every edge to the smallest neighbour seen, so a round is a few shuffles over the
edges and the number of rounds grows with the logarithm of the longest path. Minima are summed on
the map side; the joins spread a hub's edges over the tasks of its neighbours where Spark splits
skewed partitions. Edges never leave the cluster; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    # xor of hashes: order-free, and the same edges give the same mark
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable id type -> ``(id, component)``: the component is the smallest
    id that is reachable. Loops and repeats are harmless, null ends are dropped, ids without an
    edge to another id don't appear, no edges give no rows."""
    now = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now, "cc-edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # large star: each larger neighbour of u goes to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: u and its smaller neighbours go to the smallest of those
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = cut(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every edge now leads from a member to its component
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
