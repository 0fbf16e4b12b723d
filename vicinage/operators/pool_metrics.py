"""Exact statistics of pools: rates, entropies, modes, overlaps and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.scalars import clip01, meaningful_category
from vicinage.functions.scores import mean_available
from vicinage.operators.retrieval import FLAGS

KEYS = ["query_id", "pool_name"]
CATEGORIES = (*FLAGS, "spacegroup_number", "crystal_system_code")


def value_counts(pools: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = tuple(KEYS), meaningful: bool = False) -> DataFrame:
    """Counts of each value of each column: keys, ``field``, ``value``, ``n``, ``first_rank``.

    Null values are left out, with ``meaningful`` also words that say nothing. One exchange.
    """
    read = meaningful_category if meaningful else (lambda c: c.cast("string"))
    long = pools.select(*keys, F.col("rank_in_pool").alias("__rank"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), read(F.col(c)).alias("value")) for c in columns])).alias("x"))
    return long.filter(F.col("x.value").isNotNull()).groupBy(*keys, "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("__rank").alias("first_rank"))


def entropies(counts: DataFrame, *, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Per key and field: distinct values, normalised entropy (0 for a single value), dominant value and its share.

    Of equally frequent values the one with the best rank dominates, then the smaller.
    """
    totals = counts.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"),
        F.min_by("value", F.struct(-F.col("n"), F.col("first_rank"), F.col("value"))).alias("dominant_value"),
        F.max("n").alias("most"),
    )
    bits = F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")
    return totals.select(
        *keys,
        "field",
        "distinct_values",
        "total",
        F.when(F.col("distinct_values") == 1, 0.0).otherwise(bits / F.log2(F.col("distinct_values").cast("double"))).alias("entropy"),
        "dominant_value",
        (F.col("most") / F.col("total")).alias("dominant_fraction"),
    )


def top_categories(counts: DataFrame, n: int = 5, *, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """The ``n`` most frequent values of each field with their shares; equal counts by value."""
    w = Window.partitionBy(*keys, "field").orderBy(F.desc("n"), "value")
    total = F.sum("n").over(Window.partitionBy(*keys, "field"))
    return counts.withColumn("fraction", F.col("n") / total).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("first_rank")


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def metrics(pools: DataFrame) -> DataFrame:
    """One wide row per query and pool: counts, match rates, means, entropies and the similarity scores."""
    hull = F.col("energy_above_hull")
    base = pools.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        (F.count(F.lit(1)) - F.countDistinct("candidate_id")).alias("duplicate_candidate_count"),
        *[_rate(f"same_{c}").alias(f"same_{c}_rate") for c in FLAGS],
        F.avg(F.when(F.col("q_spacegroup_number").isNotNull() & F.col("spacegroup_number").isNotNull(), (F.col("spacegroup_number") == F.col("q_spacegroup_number")).cast("double"))).alias("same_spacegroup_rate"),
        F.avg(F.when(F.col("q_crystal_system_code").isNotNull() & F.col("crystal_system_code").isNotNull(), (F.col("crystal_system_code") == F.col("q_crystal_system_code")).cast("double"))).alias("same_crystal_system_rate"),
        F.avg("element_overlap_count").alias("mean_element_overlap_count"),
        F.avg("element_overlap_fraction").alias("mean_element_overlap_fraction"),
        F.avg("symmetry_distance").alias("mean_symmetry_distance"),
        F.median("symmetry_distance").alias("median_symmetry_distance"),
        F.avg("selection_score").alias("mean_selection_score"),
        F.median("selection_score").alias("median_selection_score"),
        F.avg(hull).alias("mean_energy_above_hull"),
        F.median(hull).alias("median_energy_above_hull"),
        F.stddev_samp(hull).alias("std_energy_above_hull"),
        F.avg(F.when(hull.isNotNull(), (hull <= 0.1).cast("double"))).alias("stable_fraction"),
        F.avg(F.when(hull.isNotNull(), (hull == 0).cast("double"))).alias("on_hull_fraction"),
        F.avg(F.col("known_flag").cast("double")).alias("known_synthesized_rate"),
        F.avg("formation_energy").alias("mean_formation_energy"),
        F.avg(hull.isNull().cast("double")).alias("energy_above_hull_missing_rate"),
        F.avg(F.col("formation_energy").isNull().cast("double")).alias("formation_energy_missing_rate"),
    )
    spread = entropies(value_counts(pools, CATEGORIES))
    wide = spread.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("field") == c, F.col("entropy"))).alias(f"{c}_entropy") for c in CATEGORIES],
        *[F.max(F.when(F.col("field") == c, F.col("distinct_values"))).alias(f"{c}_count") for c in CATEGORIES],
        *[F.max(F.when(F.col("field") == c, F.col("dominant_value"))).alias(f"{c}_dominant") for c in CATEGORIES],
    )
    return derived(base.join(wide, KEYS, "left"))


def derived(table: DataFrame) -> DataFrame:
    """The combined scores of a metric row; each is the mean of the parts that are available."""
    c = F.col
    symmetry = mean_available(c("same_spacegroup_rate"), c("same_crystal_system_rate"), F.lit(1.0) - clip01(c("mean_symmetry_distance") / 100))
    family = mean_available(*[c(f"same_{n}_rate") for n in FLAGS[1:]])
    chemical = mean_available(c("same_chemical_system_rate"), c("mean_element_overlap_fraction"), c("same_composition_family_rate"))
    first = table.withColumns({"symmetry_similarity_score": symmetry, "family_similarity_score": family, "chemical_similarity_score": chemical})
    structural = mean_available(c("same_prototype_family_rate"), c("same_structure_variant_rate"), c("symmetry_similarity_score"))
    second = first.withColumn("structural_metadata_similarity_score", structural)
    query = mean_available(c("chemical_similarity_score"), c("family_similarity_score"), c("structural_metadata_similarity_score"), c("stable_fraction"))
    diversity = mean_available(*[c(f"{n}_entropy") for n in ("composition_family", "material_family", "formula_family", "prototype_family", "structure_variant", "spacegroup_number", "crystal_system_code")])
    regimes = mean_available(*[c(f"{n}_entropy") for n in ("prototype_family", "structure_variant", "spacegroup_number", "crystal_system_code")])
    return second.withColumns({"query_similarity_score": query, "pool_diversity_score": diversity, "structural_regime_diversity_score": regimes})


def missing_report(pools: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Missing count and rate of each column per key; columns the table lacks are missing throughout."""
    absent = [F.sum((F.col(c).isNull() if c in pools.columns else F.lit(True)).cast("long")).alias(f"__m{i}") for i, c in enumerate(columns)]
    counted = pools.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *absent)
    entry = [F.struct(F.lit(c).alias("field"), F.col(f"__m{i}").alias("missing_count")) for i, c in enumerate(columns)]
    return counted.select(*keys, "n", F.explode(F.array(*entry)).alias("x")).select(*keys, "x.field", "x.missing_count", (F.col("x.missing_count") / F.col("n")).alias("missing_rate"))


def overlaps(pools: DataFrame) -> DataFrame:
    """Candidates that two pools of a query share: ``pool_a`` < ``pool_b`` and ``shared``. Pairs without any are absent."""
    held = pools.groupBy("query_id", "candidate_id").agg(F.sort_array(F.collect_set("pool_name")).alias("held"))
    # a candidate is in at most five pools
    pairs = held.filter(F.size("held") > 1).select("query_id", F.posexplode("held").alias("i", "pool_a"), "held").select("query_id", "pool_a", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("pool_b"))
    return pairs.groupBy("query_id", "pool_a", "pool_b").agg(F.count(F.lit(1)).alias("shared"))


def independence(pools: DataFrame) -> DataFrame:
    """Per query: entries, distinct candidates, candidates in several pools and both independence measures."""
    held = pools.groupBy("query_id", "candidate_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("pool_name").alias("held"))
    per = held.groupBy("query_id").agg(F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("unique_candidates"), F.sum((F.col("held") > 1).cast("long")).alias("in_several_pools"))
    return per.select("*", (F.lit(1.0) - F.col("in_several_pools") / F.col("entries")).alias("entry_independence"), (F.lit(1.0) - F.col("in_several_pools") / F.col("unique_candidates")).alias("candidate_independence"))


def top_references(pools: DataFrame, n: int = 15) -> DataFrame:
    """The candidates that recur most over the pools of a query."""
    per = pools.groupBy("query_id", "candidate_id").agg(
        F.countDistinct("pool_name").alias("pool_count"), F.count(F.lit(1)).alias("occurrences"), F.sum(F.lit(1.0) / F.col("rank_in_pool")).alias("rank_weight"), F.min("rank_in_pool").alias("best_rank")
    ).withColumn("rank_weight", F.round("rank_weight", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("pool_count"), F.desc("occurrences"), F.desc("rank_weight"), "best_rank", "candidate_id")
    return per.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def coverage(pools: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of candidates whose label says something, per query, pool and field, and over all pools (``pool_name`` null)."""
    known = [F.sum(meaningful_category(F.col(c)).isNotNull().cast("long")).alias(f"__k{i}") for i, c in enumerate(columns)]
    grouped = pools.groupingSets([["query_id", "pool_name"], ["query_id"]], "query_id", "pool_name").agg(F.count(F.lit(1)).alias("n"), *known)
    entry = [F.struct(F.lit(c).alias("field"), F.col(f"__k{i}").alias("classified")) for i, c in enumerate(columns)]
    return grouped.select(*KEYS, "n", F.explode(F.array(*entry)).alias("x")).select(*KEYS, "x.field", "x.classified", (F.col("n") - F.col("x.classified")).alias("unknown"), (F.col("x.classified") / F.col("n")).alias("classified_fraction"))


def pool_summary(pools: DataFrame) -> DataFrame:
    """Size, distinct counts, stable count, mean score and rows with missing fields of every pool."""
    return pools.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in ("chemical_system", "composition_family", "material_family", "formula_family", "prototype_family")],
        F.sum(F.col("is_stable_or_known").cast("long")).alias("stable_count"),
        F.avg("selection_score").alias("mean_score"),
        F.sum((F.col("missing_fields") != "").cast("long")).alias("rows_with_missing"),
    )
