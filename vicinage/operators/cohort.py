"""Comparison of query entities by their reference neighbourhoods.

Fingerprints are kept as long tables (query, pool, reference, weight) and
(query, pool, field, value, share); similarities of pairs are joins on what two
entities share. As min(a, b) + max(a, b) = a + b, the union part of a weighted
Jaccard follows from the two totals, and no full outer join is made.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.scores import mean_available, weighted_mean
from vicinage.functions.similarity import count_similarity, jaccard, numeric_similarity, profile_similarity, same_label
from vicinage.operators.components import connected_components
from vicinage.operators.pool_metrics import value_counts
from vicinage.operators.ranks import counted_below
from vicinage.session import cut_lineage

# fixed values: weights of pools and of distribution fields
POOL_WEIGHTS = {"same_family": 0.35, "adjacent_family": 0.20, "boundary_contrast": 0.30, "wildcard": 0.15}
POOL_WEIGHTS_WITH_CONTROL = {"same_family": 0.33, "adjacent_family": 0.19, "boundary_contrast": 0.28, "wildcard": 0.15, "negative_control": 0.05}
FIELD_WEIGHTS = {"chemical_system": 0.10, "composition_family": 0.10, "formula_family": 0.15, "prototype_family": 0.20, "structure_variant": 0.20, "spacegroup_number": 0.15, "crystal_system_code": 0.10}
MATCH_RATES = ("same_chemical_system_rate", "same_composition_family_rate", "same_material_family_rate", "same_formula_family_rate", "same_prototype_family_rate", "same_structure_variant_rate", "same_spacegroup_rate", "same_crystal_system_rate")
CONTEXT_RATES = ("chemical_similarity_score", "family_similarity_score", "structural_metadata_similarity_score", "query_similarity_score", "pool_diversity_score", "structural_regime_diversity_score")
IDENTITY, DISTRIBUTION, CONTEXT, PROFILE = 0.45, 0.35, 0.20, 0.40


def fingerprint(pools: DataFrame) -> DataFrame:
    """The nested fingerprint of every query: ranked references by pool, membership and distinct references.

    A pool is bounded by its size, so the arrays are too.
    """
    per = pools.groupBy("query_id", "pool_name").agg(F.sort_array(F.collect_list(F.struct("rank_in_pool", "candidate_id", "selection_score", "chemical_system", "prototype_family"))).alias("neighbours"))
    ranked = per.select("query_id", F.struct("pool_name", F.size("neighbours").alias("row_count"), F.transform("neighbours", lambda n: n["candidate_id"]).alias("reference_ids_ranked"), "neighbours").alias("pool"))
    return ranked.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("pool.pool_name").alias("name"), F.col("pool").alias("pool"))))).alias("pools")).withColumn(
        "all_unique_reference_ids", F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values("pools"), lambda p: p["reference_ids_ranked"]))))
    )


def rank_table(pools: DataFrame) -> DataFrame:
    """``query_id``, ``pool_name``, ``candidate_id``, ``weight`` = 1 / log2(rank + 1), of the best rank."""
    first = pools.groupBy("query_id", "pool_name", "candidate_id").agg(F.min("rank_in_pool").alias("r"))
    return first.select("query_id", "pool_name", "candidate_id", (F.lit(1.0) / F.log2(F.col("r") + F.lit(1.0))).alias("weight"))


def _all_pairs(ids: DataFrame, limit: int) -> DataFrame:
    """Ordered pairs of a stated set of ids of checked size."""
    n = ids.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"exact comparison of all pairs is limited to {limit} entities")
    small = F.broadcast(ids.select(F.col("query_id").alias("b")))
    return ids.select(F.col("query_id").alias("a")).join(small, F.col("a") < F.col("b"))


def _pairs_sharing(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    a = table.select(F.col("query_id").alias("a"), *keys, F.col(value).alias("x"))
    b = table.select(F.col("query_id").alias("b"), *keys, F.col(value).alias("y"))
    return a.join(b, list(keys)).filter("a < b")


def identity_similarity(pools: DataFrame, pairs: DataFrame, weights: Mapping[str, float] = POOL_WEIGHTS) -> DataFrame:
    """Per pair: rank-weighted Jaccard of each pool, Jaccard of all references and their combination."""
    table = rank_table(pools)
    totals = table.groupBy("query_id").agg(*[F.sum(F.when(F.col("pool_name") == p, F.col("weight"))).alias(f"t_{p}") for p in weights], F.countDistinct("candidate_id").alias("n_all"))
    shared = _pairs_sharing(table, ["pool_name", "candidate_id"], "weight").groupBy("a", "b").agg(*[F.sum(F.when(F.col("pool_name") == p, F.least("x", "y"))).alias(f"s_{p}") for p in weights])
    every = table.select("query_id", "candidate_id", F.lit(1).alias("one")).distinct()
    common = _pairs_sharing(every, ["candidate_id"], "one").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    left = totals.select(F.col("query_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in totals.columns[1:]])
    right = totals.select(F.col("query_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in totals.columns[1:]])
    rows = pairs.join(left, "a", "left").join(right, "b", "left").join(shared, ["a", "b"], "left").join(common, ["a", "b"], "left")
    by_pool = {}
    for p in weights:
        s = F.coalesce(f"s_{p}", F.lit(0.0))
        both = F.coalesce(f"t_{p}_a", F.lit(0.0)) + F.coalesce(f"t_{p}_b", F.lit(0.0))
        by_pool[p] = F.when(both > 0, s / F.nullif(both - s, F.lit(0.0)))
    n = F.coalesce("common", F.lit(0))
    union = F.coalesce("n_all_a", F.lit(0)) + F.coalesce("n_all_b", F.lit(0)) - n
    staged = rows.select("a", "b", *[v.alias(f"identity_{p}") for p, v in by_pool.items()], F.try_divide(n.cast("double"), F.nullif(union.cast("double"), F.lit(0.0))).alias("all_reference_jaccard"))
    pooled = staged.withColumn("pool_score", weighted_mean([(F.col(f"identity_{p}"), w) for p, w in weights.items()]))
    return pooled.withColumn("identity_similarity", weighted_mean([(F.col("pool_score"), 0.80), (F.col("all_reference_jaccard"), 0.20)]))


def distribution_similarity(pools: DataFrame, pairs: DataFrame, weights: Mapping[str, float] = POOL_WEIGHTS, fields: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Per pair: weighted Jensen-Shannon similarity of the value distributions of the pools.

    Only values that both sides have contribute unequal terms: of the rest, the
    divergence is half their share on either side, which follows from the totals.
    """
    counts = value_counts(pools, list(fields))
    shares = cut_lineage(counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("query_id", "pool_name", "field"))).select("query_id", "pool_name", "field", "value", "share"))
    have = shares.select("query_id", "pool_name", "field").distinct()
    middle = (F.col("x") + F.col("y")) / 2
    both = _pairs_sharing(shares, ["pool_name", "field", "value"], "share").groupBy("a", "b", "pool_name", "field").agg(
        F.sum(F.col("x") / 2 * F.log2(F.col("x") / middle) + F.col("y") / 2 * F.log2(F.col("y") / middle)).alias("inner"), F.sum("x").alias("in_a"), F.sum("y").alias("in_b")
    )
    grid = pairs.select("a", "b", F.explode(F.array(*[F.struct(F.lit(p).alias("pool_name"), F.lit(f).alias("field")) for p in weights for f in fields])).alias("g")).select("a", "b", "g.pool_name", "g.field")
    side = lambda end: have.select(F.col("query_id").alias(end), "pool_name", "field", F.lit(True).alias(f"has_{end}"))
    rows = grid.join(side("a"), ["a", "pool_name", "field"], "left").join(side("b"), ["b", "pool_name", "field"], "left").join(both, ["a", "b", "pool_name", "field"], "left")
    divergence = F.coalesce("inner", F.lit(0.0)) + (F.lit(1.0) - F.coalesce("in_a", F.lit(0.0))) / 2 + (F.lit(1.0) - F.coalesce("in_b", F.lit(0.0))) / 2
    similarity = F.lit(1.0) - F.sqrt(F.greatest(divergence, F.lit(0.0)))
    value = F.when(F.col("has_a") & F.col("has_b"), F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0))).when(F.col("has_a") | F.col("has_b"), 0.0)
    told = rows.withColumn("s", value)
    pick = lambda p, f: F.max(F.when((F.col("pool_name") == p) & (F.col("field") == f), F.col("s"))).alias(f"{p}__{f}")
    wide = told.groupBy("a", "b").agg(*[pick(p, f) for p in weights for f in fields])
    pooled = wide.select("a", "b", *[weighted_mean([(F.col(f"{p}__{f}"), w) for f, w in fields.items()]).alias(f"distribution_{p}") for p in weights])
    return pooled.withColumn("distribution_similarity", weighted_mean([(F.col(f"distribution_{p}"), w) for p, w in weights.items()]))


def context_similarity(wide: DataFrame, pairs: DataFrame, weights: Mapping[str, float] = POOL_WEIGHTS) -> DataFrame:
    """Per pair: similarity of the match rates, context scores and sizes of the pools (``wide``: a struct per pool)."""
    left = wide.select(F.col("query_id").alias("a"), *[F.col(p).alias(f"{p}_a") for p in weights])
    right = wide.select(F.col("query_id").alias("b"), *[F.col(p).alias(f"{p}_b") for p in weights])
    rows = pairs.join(left, "a", "left").join(right, "b", "left")
    names = (*MATCH_RATES, *CONTEXT_RATES)
    pooled = rows.select(
        "a",
        "b",
        *[
            mean_available(*[numeric_similarity(F.col(f"{p}_a.{m}"), F.col(f"{p}_b.{m}")) for m in names], count_similarity(F.col(f"{p}_a.n_candidates"), F.col(f"{p}_b.n_candidates"))).alias(f"context_{p}")
            for p in weights
        ],
    )
    return pooled.withColumn("context_feature_similarity", weighted_mean([(F.col(f"context_{p}"), w) for p, w in weights.items()]))


def compare_all(pools: DataFrame, wide: DataFrame, profiles: DataFrame, *, measures: Sequence[str], reliability: str, limit: int = 2_500, weights: Mapping[str, float] = POOL_WEIGHTS) -> DataFrame:
    """All pairs of the queries of ``profiles`` (query_id, measures, reliability, labels) with their similarities."""
    ids = profiles.select("query_id").distinct()
    pairs = cut_lineage(_all_pairs(ids, limit))
    keep = list(dict.fromkeys(["query_id", *measures, reliability, "chemistry"]))
    chemistry = F.struct("q_elements", "q_composition_family", "q_formula_family", "q_prototype_family", "q_structure_variant", F.col("q_crystal_system_code").cast("string").alias("q_crystal_system"))
    told = profiles.withColumn("chemistry", chemistry).select(*keep)
    left = told.select(F.col("query_id").alias("a"), F.struct(*keep[1:]).alias("pa"))
    right = told.select(F.col("query_id").alias("b"), F.struct(*keep[1:]).alias("pb"))
    base = pairs.join(left, "a").join(right, "b")
    label = lambda n: same_label(F.col(f"pa.chemistry.{n}"), F.col(f"pb.chemistry.{n}"))
    chem = weighted_mean([(jaccard(F.col("pa.chemistry.q_elements"), F.col("pb.chemistry.q_elements")), 0.40), (label("q_composition_family"), 0.10), (label("q_formula_family"), 0.20), (label("q_prototype_family"), 0.10), (label("q_structure_variant"), 0.10), (label("q_crystal_system"), 0.10)])
    base = base.select("a", "b", profile_similarity([(F.col(f"pa.{m}"), F.col(f"pb.{m}")) for m in measures]).alias("profile_similarity"), chem.alias("chemistry_similarity"), F.sqrt(F.col(f"pa.{reliability}") * F.col(f"pb.{reliability}")).alias("pair_reliability"))
    parts = (identity_similarity(pools, pairs, weights).select("a", "b", "all_reference_jaccard", "identity_similarity"), distribution_similarity(pools, pairs, weights).select("a", "b", "distribution_similarity"), context_similarity(wide, pairs, weights).select("a", "b", "context_feature_similarity"))
    for p in parts:
        base = base.join(p, ["a", "b"], "left")
    c = F.col
    near = base.withColumn("neighbourhood_similarity", weighted_mean([(c("identity_similarity"), IDENTITY), (c("distribution_similarity"), DISTRIBUTION), (c("context_feature_similarity"), CONTEXT)]))
    near = near.withColumn("combined_similarity", weighted_mean([(c("profile_similarity"), PROFILE), (c("neighbourhood_similarity"), 1 - PROFILE)]))
    return near.withColumn("discordance", F.abs(c("profile_similarity") - c("neighbourhood_similarity"))).withColumn("discordance_type", discordance_type(c("profile_similarity"), c("neighbourhood_similarity")))


def discordance_type(profile: Column, neighbourhood: Column) -> Column:
    return (
        F.when(profile.isNull() | neighbourhood.isNull(), "insufficient_components")
        .when((profile >= 0.90) & (neighbourhood <= 0.50), "similar_profile_different_reference_neighbourhood")
        .when((profile <= 0.65) & (neighbourhood >= 0.85), "different_profile_similar_reference_neighbourhood")
        .when(profile > neighbourhood, "profile_similarity_exceeds_neighbourhood_similarity")
        .when(neighbourhood > profile, "neighbourhood_similarity_exceeds_profile_similarity")
        .otherwise("aligned")
    )


def both_ways(pairs: DataFrame, similarity: str) -> DataFrame:
    """Long symmetric form: ``id``, ``other``, ``similarity``."""
    one = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col(similarity).alias("similarity"))
    return one.unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), F.col(similarity).alias("similarity")))


def filled(long: DataFrame) -> DataFrame:
    """``long`` with missing similarities replaced by the median of all cells, the diagonal of ones included."""
    cells = long.select("similarity").unionByName(long.select("id").distinct().select(F.lit(1.0).alias("similarity")))
    middle = cells.filter(F.col("similarity").isNotNull() & ~F.isnan("similarity")).agg(F.median("similarity").alias("__m"))
    bad = F.col("similarity").isNull() | F.isnan("similarity")
    return long.join(F.broadcast(middle)).withColumn("similarity", F.least(F.greatest(F.when(bad, F.col("__m")).otherwise(F.col("similarity")), F.lit(0.0)), F.lit(1.0))).drop("__m")


def nearest(long: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar others of every entity; equal similarities by id."""
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return long.withColumn("neighbour_rank", F.row_number().over(w)).filter(F.col("neighbour_rank") <= k)


def distinctiveness(long: DataFrame, k: int) -> DataFrame:
    """Nearest distance, mean distance to the ``k`` nearest and its percentile rank (equal values share the mean rank)."""
    per = nearest(long, k).groupBy("id").agg(F.min(F.lit(1.0) - F.col("similarity")).alias("nearest_distance"), F.avg(F.lit(1.0) - F.col("similarity")).alias("mean_distance"))
    per = per.withColumn("mean_distance", F.round("mean_distance", 9))
    # ranks over distinct values; how many lie below follows from counts of values, which are joined back
    values = per.groupBy("mean_distance").agg(F.count(F.lit(1)).alias("ties"))
    below = counted_below(values, "mean_distance", "ties")
    total = per.agg(F.count(F.lit(1)).alias("total"))
    return per.join(below, "mean_distance").join(F.broadcast(total)).select("id", "nearest_distance", "mean_distance", ((F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")).alias("percentile_rank"))


def redundancy(pairs: DataFrame, *, combined: float = 0.90, component: float = 0.80) -> DataFrame:
    """Groups of entities joined by pairs that are alike in every respect: ``id``, ``group_id``, ``group_size``.

    Groups are numbered by size, largest first, then by their smallest id.
    """
    close = pairs.filter((F.col("combined_similarity") >= combined) & (F.col("profile_similarity") >= component) & (F.col("neighbourhood_similarity") >= component))
    members = connected_components(close, left="a", right="b")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    # in one order of size and id; (-size, component) is that of the range
    placed = counted_below(sizes.select(F.struct((-F.col("group_size")).alias("s"), F.col("component")).alias("place"), F.lit(1).alias("one"), "component", "group_size"), "place", "one")
    numbered = placed.select("component", "group_size", (F.col("below") + 1).cast("int").alias("group_id"))
    return members.join(numbered, "component").select(F.col("node").alias("id"), "group_id", "group_size")


def between_clusters(long: DataFrame, labels: DataFrame, *, margin: float = 0.10) -> DataFrame:
    """Per entity: mean similarity to its own and to the best other cluster, and whether the gap is small.

    A lone member scores 1 with its own cluster; with a single cluster the other
    is 0 with cluster 0.
    """
    own = labels.select(F.col("id").alias("id"), F.col("cluster_id").alias("own"))
    other = labels.select(F.col("id").alias("other"), F.col("cluster_id").alias("theirs"))
    means = long.join(own, "id").join(other, "other").groupBy("id", "own", "theirs").agg(F.avg("similarity").alias("mean"))
    folded = means.groupBy("id", "own").agg(
        F.max(F.when(F.col("own") == F.col("theirs"), F.col("mean"))).alias("own_score"), F.max(F.when(F.col("own") != F.col("theirs"), F.struct(F.round("mean", 12).alias("m"), (-F.col("theirs")).alias("t")))).alias("best")
    )
    rows = own.join(folded, ["id", "own"], "left")
    told = rows.select("id", F.col("own").alias("cluster_id"), F.coalesce("own_score", F.lit(1.0)).alias("own_similarity"), F.coalesce(F.col("best.m"), F.lit(0.0)).alias("other_similarity"), F.coalesce(-F.col("best.t"), F.lit(0)).alias("other_cluster"))
    return told.withColumn("near_border", (F.col("own_similarity") - F.col("other_similarity")) <= margin)


def cluster_summary(long: DataFrame, labels: DataFrame, reliability: DataFrame) -> DataFrame:
    """Per cluster: size, mean similarity within (1 for a lone member) and the medoid.

    The medoid has the least mean distance to all members, itself included;
    of equals the more reliable, then the smaller id.
    """
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    a, b = labels.select("id", F.col("cluster_id").alias("cluster_id")), labels.select(F.col("id").alias("other"), F.col("cluster_id").alias("c2"))
    inner = long.join(a, "id").join(b, "other").filter("cluster_id = c2")
    sums = inner.groupBy("id").agg(F.sum(F.lit(1.0) - F.col("similarity")).alias("d"))
    placed = a.join(sums, "id", "left").join(sizes, "cluster_id").join(reliability, "id", "left")
    placed = placed.withColumn("mean_distance", F.round(F.coalesce("d", F.lit(0.0)) / F.col("cluster_size"), 9))
    medoids = placed.groupBy("cluster_id").agg(F.min_by("id", F.struct("mean_distance", (-F.coalesce("reliability", F.lit(0.0))).alias("r"), "id")).alias("representative"))
    within = inner.groupBy("cluster_id").agg(F.avg("similarity").alias("mean_similarity"))
    return sizes.join(medoids, "cluster_id").join(within, "cluster_id", "left").withColumn("mean_similarity", F.coalesce("mean_similarity", F.lit(1.0)))


def reference_frequency(pools: DataFrame) -> DataFrame:
    """Per reference: number of queries that hold it, and whether only one does."""
    return pools.groupBy("candidate_id").agg(F.countDistinct("query_id").alias("query_count"), F.countDistinct("pool_name").alias("pool_count")).withColumn("exclusive", F.col("query_count") == 1)


def effective_clusters(labels: DataFrame) -> DataFrame:
    """exp of the entropy (nats) of cluster sizes."""
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s")).select(F.exp(F.log(F.col("t").cast("double")) - F.col("s") / F.col("t")).alias("effective_clusters"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks of ties, over rows that have both values.

    Ranks come from counts of distinct values, which are added up in ranges, so
    no task holds all of them;
    null for constant input.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def ranked(rows: DataFrame, c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return rows.join(counted_below(counts, c, "n").select(c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{c}")), c)

    both = ranked(ranked(rows, "x"), "y")
    moments = both.agg(F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.count(F.lit(1)).alias("n"))
    return moments.select(F.try_divide("c", F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))).alias("rho"), "n")


def explain_pairs(pairs: DataFrame) -> DataFrame:
    """Share of each part in the combined similarity, the leading part and a sentence."""
    c = F.col
    parts = {"profile": c("profile_similarity") * PROFILE, "identity": c("identity_similarity") * (1 - PROFILE) * IDENTITY, "distribution": c("distribution_similarity") * (1 - PROFILE) * DISTRIBUTION, "context": c("context_feature_similarity") * (1 - PROFILE) * CONTEXT}
    staged = pairs.withColumns({f"__{k}": F.coalesce(v, F.lit(0.0)) for k, v in parts.items()})
    total = sum((c(f"__{k}") for k in parts), F.lit(0.0))
    shares = staged.withColumns({f"{k}_share": F.try_divide(c(f"__{k}"), F.nullif(total, F.lit(0.0))) for k in parts})
    lead = F.array_max(F.array(*[F.struct(F.round(c(f"{k}_share"), 9).alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(parts)]))["k"]
    text = F.format_string("%s and %s: combined similarity %.2f, led by %s; %s.", c("a"), c("b"), c("combined_similarity"), lead, F.replace(c("discordance_type"), F.lit("_"), F.lit(" ")))
    return shares.withColumns({"leading_part": lead, "explanation": text}).drop(*[f"__{k}" for k in parts])


# fixed values: weights of the label fields of which the coverage decides how far a comparison can be explained
COVERAGE_WEIGHTS = {"material_family": 0.20, "composition_family": 0.10, "prototype_family": 0.25, "formula_family": 0.25, "structure_variant": 0.15, "chemical_system": 0.05}
# fixed values: fields whose diversity is compared, and the bands of confidence and of mean difference
ENTROPY_FIELDS = ("prototype_family", "material_family", "formula_family", "spacegroup_number")
CONFIDENCE_BANDS = ((0.80, "high"), (0.55, "moderate"))
DIVERSITY_BANDS = ((0.03, "very_similar"), (0.12, "modest_differences"))


def prepare_cohort(df: DataFrame, id_column: str, core: Sequence[str], *, confidence: str, completeness: str, least_confidence: float = 0.5, least_completeness: float = 0.5) -> DataFrame:
    """``df`` with ``id``, ``missing_core`` (absent core measures), ``low_confidence`` and ``low_completeness``.

    Blank ids are an error, and so are repeated ones; a null measure is not low.
    """
    named = df.withColumn("id", F.trim(F.col(id_column).cast("string"))).filter(F.col("id").isNotNull())
    # a few ids for the message
    bad = [r["id"] for r in named.groupBy("id").count().filter("count > 1 OR id = ''").limit(5).collect()]
    if bad:
        raise ValueError(f"ids must be given and different: {bad}")
    absent = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in core), F.lit(0))
    below = lambda c, least: F.coalesce(F.col(c) < least, F.lit(False))
    return named.withColumns({"missing_core": absent, "low_confidence": below(confidence, least_confidence), "low_completeness": below(completeness, least_completeness)})


def eligible(prepared: DataFrame, known: DataFrame, reliability: Sequence[str], *, include_low: bool = False) -> DataFrame:
    """One row per entity: what speaks against a comparison, its ``reliability`` (mean of
    the clipped measures that are there, else 0) and whether it is ``eligible``.

    ``known`` has the ``id`` of the entities whose neighbourhood is there.
    """
    marked = prepared.join(known.select("id", F.lit(True).alias("__known")), "id", "left")
    measures = [F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c)), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))) for c in reliability]
    has = F.coalesce("__known", F.lit(False))
    low = F.col("low_confidence") | F.col("low_completeness")
    return marked.select("id", "missing_core", "low_confidence", "low_completeness", has.alias("has_neighbours"), F.coalesce(mean_available(*measures), F.lit(0.0)).alias("reliability"), (has & (F.col("missing_core") == 0) & (F.lit(include_low) | ~low)).alias("eligible"))


def profile_reading(pairs: DataFrame) -> DataFrame:
    """How the profiles of a pair stand to its neighbourhoods: ``discordance`` and ``reading``."""
    p, h = F.round("profile_similarity", 9), F.round("neighbourhood_similarity", 9)
    gap = F.abs(p - h)
    reading = F.when(p.isNull() | h.isNull(), "not_assessed").when(F.round(gap, 9) < 0.05, "profile_agrees_with_neighbourhood").when(p >= h, "profile_hides_differences").otherwise("profile_stresses_differences")
    return pairs.select("a", "b", gap.alias("discordance"), reading.alias("reading"))


def explainability(pairs: DataFrame, coverage: DataFrame, entropies: DataFrame, reliability: Column | None = None) -> DataFrame:
    """How far pairs can be explained, and how their neighbourhoods differ in diversity.

    ``coverage`` has ``classified_fraction`` per query and field, ``entropies``
    ``entropy`` per query and field. ``confidence`` is the root of the pair's
    reliability (1 if not given) times the mean coverage of the two, or the
    reliability where a coverage is absent. Of equally wide differences the field
    whose name is smaller counts.
    """
    weights = F.create_map(*[F.lit(x) for f, w in COVERAGE_WEIGHTS.items() for x in (f, w)])
    weighted = coverage.withColumn("w", F.element_at(weights, F.col("field"))).groupBy("query_id").agg((F.sum(F.col("classified_fraction") * F.col("w")) / F.sum("w")).alias("coverage"))
    both = pairs.join(weighted.select(F.col("query_id").alias("a"), F.col("coverage").alias("coverage_a")), "a", "left").join(weighted.select(F.col("query_id").alias("b"), F.col("coverage").alias("coverage_b")), "b", "left")
    trust = F.lit(1.0) if reliability is None else reliability
    held = F.sqrt(F.greatest(trust, F.lit(0.0)) * F.sqrt(F.greatest(F.col("coverage_a"), F.lit(0.0)) * F.greatest(F.col("coverage_b"), F.lit(0.0))))
    confidence = F.coalesce(held, trust)
    label = F.lit("low")
    for least, name in reversed(CONFIDENCE_BANDS):
        label = F.when(F.round(confidence, 9) >= least, name).otherwise(label)
    label = F.when(F.col("coverage_a").isNull() | F.col("coverage_b").isNull(), "unavailable_coverage").otherwise(label)
    one = entropies.select(F.col("query_id").alias("a"), "field", F.col("entropy").alias("x"))
    two = entropies.select(F.col("query_id").alias("b"), "field", F.col("entropy").alias("y"))
    gaps = pairs.join(one, "a").join(two, ["b", "field"]).withColumn("gap", F.abs(F.col("x") - F.col("y")))
    folded = gaps.groupBy("a", "b").agg(F.avg("gap").alias("mean_entropy_difference"), F.min_by("field", F.struct(-F.round("gap", 9), F.col("field"))).alias("widest_field"))
    mean = F.round("mean_entropy_difference", 9)
    reading = F.when(mean < DIVERSITY_BANDS[0][0], DIVERSITY_BANDS[0][1]).when(mean < DIVERSITY_BANDS[1][0], DIVERSITY_BANDS[1][1]).otherwise("substantial_differences")
    return both.withColumns({"confidence": confidence, "confidence_label": label}).join(folded, ["a", "b"], "left").withColumn("diversity_reading", F.when(mean.isNotNull(), reading)).select("a", "b", "coverage_a", "coverage_b", "confidence", "confidence_label", "mean_entropy_difference", "widest_field", "diversity_reading")
