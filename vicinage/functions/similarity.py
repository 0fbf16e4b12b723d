"""Similarities of sets, maps, distributions and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinage.functions.scalars import clip01, number


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union that two arrays have in common; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the greater weights of two maps; null without any key."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"))))
    low = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.least(p["x"], p["y"]))
    high = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.greatest(p["x"], p["y"]))
    return F.try_divide(low, F.nullif(high, F.lit(0.0)))


def rank_weights(ids: Column) -> Column:
    """Map of id to ``1 / log2(rank + 2)`` for a ranked array (first rank 0 counts as 1).

    The first place of an id counts; blanks and repeats use up a rank.
    """
    placed = F.transform(ids, lambda x, i: F.struct(F.trim(x).alias("id"), (F.lit(1.0) / F.log2(i + 3)).alias("w")))
    kept = F.filter(placed, lambda p: p["id"].isNotNull() & (p["id"] != ""))
    first = F.filter(kept, lambda p, i: F.array_position(F.transform(kept, lambda q: q["id"]), p["id"]) == i + 1)
    return F.map_from_entries(first)


def fractions(counts: Column) -> Column:
    """A map of counts scaled to sum to one; negative and null values are dropped."""
    kept = F.map_filter(counts, lambda _, v: v.isNotNull() & (v >= 0))
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.transform_values(kept, lambda _, v: v / total)).otherwise(F.transform_values(kept, lambda _, v: v.cast("double")))


def jensen_shannon(a: Column, b: Column) -> Column:
    """One minus the root of the Jensen-Shannon divergence (base 2) of two maps.

    Null if both are empty, 0 if one is.
    """
    x, y = fractions(a), fractions(b)
    pairs = F.map_values(F.map_zip_with(x, y, lambda _, p, q: F.struct(F.coalesce(p, F.lit(0.0)).alias("p"), F.coalesce(q, F.lit(0.0)).alias("q"))))

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    total = F.aggregate(pairs, F.lit(0.0), lambda s, r: s + term(r["p"], (r["p"] + r["q"]) / 2) / 2 + term(r["q"], (r["p"] + r["q"]) / 2) / 2)
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    value = F.lit(1.0) - F.sqrt(F.greatest(total, F.lit(0.0)))
    return F.when(empty_a & empty_b, None).when(empty_a | empty_b, 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def numeric_similarity(a: Column, b: Column) -> Column:
    """One minus the gap of two values clipped to 0..1; null if both are null, 0 if one is."""
    x, y = clip01(a), clip01(b)
    return F.when(x.isNull() & y.isNull(), None).when(x.isNull() | y.isNull(), 0.0).otherwise(F.lit(1.0) - F.abs(x - y))


def count_similarity(a: Column, b: Column) -> Column:
    """Smaller over greater count; two zeros are alike; null if both are null, 0 if one is."""
    x, y = number(a), number(b)
    ratio = F.when(F.greatest(x, y) > 0, F.try_divide(F.least(x, y), F.greatest(x, y))).otherwise(1.0)
    return F.when(x.isNull() & y.isNull(), None).when(x.isNull() | y.isNull(), 0.0).otherwise(ratio)


def profile_similarity(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """One minus the root mean square gap over the measures both sides have; null without any."""
    squares, n = F.lit(0.0), F.lit(0)
    for a, b in pairs:
        x, y = clip01(a), clip01(b)
        both = x.isNotNull() & y.isNotNull()
        squares = squares + F.when(both, (x - y) * (x - y)).otherwise(0.0)
        n = n + F.when(both, 1).otherwise(0)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(squares / F.greatest(n, F.lit(1)))))


def same_label(a: Column, b: Column) -> Column:
    """1 for equal texts without regard to case, else 0; null if both are blank, 0 if one is."""
    x, y = F.nullif(F.lower(F.trim(a)), F.lit("")), F.nullif(F.lower(F.trim(b)), F.lit(""))
    return F.when(x.isNull() & y.isNull(), None).when(x == y, 1.0).otherwise(0.0)
