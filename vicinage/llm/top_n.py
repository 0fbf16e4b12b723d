"""The N best items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from vicinage.session import cut_lineage


def bounded_heap(column: Column, size: int) -> Column:
    """Aggregate: the ``size`` smallest values of ``column``, ascending.

    Spark's own bounded priority queue: every task keeps a heap of at most
    ``size`` values per group before the shuffle, and the heaps are merged after
    it, so that a group of any length reaches the reducer as a few short arrays.
    """
    return InternalFunction.collect_top_k(column, size, True)


def top_n_per_group(
    df: DataFrame,
    group: str | Sequence[str],
    item: str,
    score: str,
    n: int,
    *,
    lowest: float | None = None,
    highest: float | None = None,
    drop_self: bool = False,
    spare: int = 3,
) -> DataFrame:
    """The ``n`` items with the highest ``score`` in every group.

    Result: the group columns, the item, ``score`` and ``rank`` (1 to ``n``).

    * An item that recurs in a group counts once, with its highest score.
    * Equal scores are ordered by the item, smaller first (strings by code point),
      so that the result never depends on row order.
    * Rows whose group, item or score is null or NaN, or whose score lies outside
      ``lowest..highest``, don't count; with ``drop_self`` neither does an item
      that equals its (single) group column. A group without any row left is absent.
    * An empty table gives an empty result. Other columns are ignored, whatever
      their names.

    One exchange: every task keeps a heap of the ``(1 + spare) * n`` best entries
    of each group, and the heaps are merged by group, so that a hot group reaches
    its reducer as a few short arrays. An item may stand in a heap several times;
    its first entry is its highest score, so the heap gives the exact result if it
    holds ``n`` different items or all entries of the group. For other groups
    (whose best entries are nearly all repeats) the items' highest scores are
    made first, spread over all tasks by (group, item), and the heaps from them.
    """
    groups = [group] if isinstance(group, str) else list(group)
    if n < 1:
        raise ValueError("n must be at least 1")
    if drop_self and len(groups) != 1:
        raise ValueError("drop_self needs a single group column")
    keys = [f"__g{i}" for i in range(len(groups))]
    value = df[score].cast("double")
    rows = df.select(*[df[g].alias(k) for g, k in zip(groups, keys)], df[item].alias("__item"), value.alias("__score"))
    keep = F.col("__item").isNotNull() & F.col("__score").isNotNull() & ~F.isnan("__score")
    for k in keys:
        keep &= F.col(k).isNotNull()
    if lowest is not None:
        keep &= F.col("__score") >= lowest
    if highest is not None:
        keep &= F.col("__score") <= highest
    if drop_self:
        keep &= F.col(keys[0]) != F.col("__item")
    rows = rows.filter(keep)
    # an entry is (-score, item): score descending, item ascending; "+ 0" makes -0.0 and 0.0 equal
    entry = F.struct((-F.col("__score") + F.lit(0.0)).alias("low"), F.col("__item").alias("item"))
    size = (1 + spare) * n
    merged = rows.groupBy(*keys).agg(bounded_heap(entry, size).alias("__all"))
    # positions of first entries, at most ``size`` of them
    first = F.filter("__all", lambda e, i: i == F.array_position(F.transform("__all", lambda x: x["item"]), e["item"]) - 1)
    found = cut_lineage(merged.select(*keys, F.slice(first, 1, n).alias("__heap"), (F.size("__all") < size).alias("__whole")))
    settled = F.col("__whole") | (F.size("__heap") == n)
    heaps = found.filter(settled).select(*keys, "__heap")
    unsettled = found.filter(~settled).select(*keys)
    if not unsettled.isEmpty():
        best = rows.join(unsettled, keys, "left_semi").groupBy(*keys, "__item").agg(F.max("__score").alias("__score"))
        heaps = heaps.unionByName(best.groupBy(*keys).agg(bounded_heap(entry, n).alias("__heap")))
    return heaps.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], F.posexplode("__heap").alias("__at", "__entry")).select(
        *groups,
        F.col("__entry.item").alias(item),
        (-F.col("__entry.low") + F.lit(0.0)).alias("score"),
        (F.col("__at") + 1).cast("int").alias("rank"),
    )
