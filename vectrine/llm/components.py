"""Connected components of an edge table by alternating large and small stars.

Each round points nodes at the least neighbour they know of, first for neighbours above a node, then for
those below, until every edge leads to its component's least node. Minima are partial aggregates. Nodes with
many neighbours, of which there are few, hand their minimum out by a broadcast and all others by a shuffle, so
no neighbourhood has to fit into a task. Every round is kept in the shared folder. Nulls are not allowed; no
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.common import cut, keyed


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return r[0], r[1] or 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component, the least node it is connected to; a row for each node that has an edge to another."""
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = cut(least.select("u", F.least("u", "m").alias("m"), "n"))
        large = keyed(both, least, "u", "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = keyed(large, low, "u", "n", before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
