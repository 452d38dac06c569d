"""Connected components by alternating large and small stars, on executors only.

Every round rewrites edges (big, small): the large star hangs a node's larger neighbours on its smallest neighbour, the
small star its smaller ones.  Minima combine map-side; joins are between written tables, so Spark can split the edges of a
node that has very many.  Rounds are few: about the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import drop, table


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(big, small))")).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of the nodes of edges (a, b), both bigint, that aren't the smallest of their component; component is the smallest id reachable.  Loops, repeated edges and either direction are fine; null ends are left out."""
    now = table(edges.filter("a != b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        least = table(now.select(F.col("small").alias("node"), "small").unionByName(now.select(F.col("big").alias("node"), "small")).groupBy("node").agg(F.min("small").alias("least")), "least")
        large = table(now.join(least.hint("merge"), now.small == least.node).select("big", F.col("least").alias("small")).distinct(), "edges")
        drop(least)
        least = table(large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("least")), "least")
        moved = large.join(least.hint("merge"), large.big == least.node).filter("small != least").select(F.col("small").alias("big"), F.col("least").alias("small"))
        after = table(moved.unionByName(least.select(F.col("node").alias("big"), F.col("least").alias("small"))).distinct(), "edges")
        drop(now, large, least)
        last, state, now = state, _state(after), after
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("big").alias("id"), F.col("small").alias("component"))
