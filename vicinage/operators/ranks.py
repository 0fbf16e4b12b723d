"""Positions in a global order, without moving all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.session import cut_lineage


def counted_below(counts: DataFrame, value: str, n: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """``counts`` with ``below``: the sum of ``n`` over all smaller values (of the same ``keys``).

    ``counts`` has one row per value (and keys). Values are split into ranges,
    summed up within each, and offset by the sums of the ranges before; only the
    ranges' sums meet in one place, one row a range and key.
    """
    ranged = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(n).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, [*keys, "__range"]).withColumn("below", F.col("__offset") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop("__range", "__offset")


def medians(long: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``median``: the exact median of the values of each key; nulls don't count."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    placed = counted_below(counts, value, "n", keys=[key])
    total = placed.groupBy(key).agg(F.sum("n").alias("total"))
    both = placed.join(F.broadcast(total), key)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    # the one or two values in the middle
    middle = both.filter(holds(low) | holds(high)).withColumn("w", holds(low).cast("int") + holds(high).cast("int"))
    return middle.groupBy(key).agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("median"))
