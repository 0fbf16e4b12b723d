"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.session import cut_lineage


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star; edges are (u, v) with u > v.

    Minima are partial aggregates joined back, so a hub's edges are spread by the
    join's skew handling and never gathered.
    """
    both = _undirected(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
    return small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def connected_components(edges: DataFrame, *, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """``node``, ``component`` for every node of an edge: the smallest node reachable.

    Self-loops, repeated and reversed edges are fine; rows with a null end don't
    count. Nodes without an edge to another node are absent. Alternating star
    contractions take about a logarithmic number of rounds even for long chains;
    each round is written to the checkpoint folder. Only a count and a checksum
    reach the driver.
    """
    current = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter(F.col(left).isNotNull() & F.col(right).isNotNull()).filter("u != v").distinct()
    current = cut_lineage(current)
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
        current = cut_lineage(_stars(current))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
