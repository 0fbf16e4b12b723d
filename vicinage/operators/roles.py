"""Named evidence concepts and rule-based context scores of queries.

Both work on one wide row per query, a struct of metrics for each pool, in
staged projections, so that no single expression grows past what Spark compiles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.scalars import clip01, clip01_or_zero, number_or
from vicinage.functions.scores import balance_by_gap, balance_by_ratio, closeness, context_gate, contextual_pattern, entropy_of, label_specificity, mean_available, mean_clipped, norm_count, plausibility, profile_confidence, role_confidence, strength_band, weighted_score
from vicinage.operators.retrieval import POOLS

# fixed values: weights of the parts of each role
ROLE_WEIGHTS = {
    "hub": {
        "same_family_pool_size": 0.15, "same_composition_match": 0.10, "same_material_match": 0.10, "same_formula_match": 0.20, "same_prototype_match": 0.20,
        "same_family_stable_fraction": 0.10, "same_family_known_synthesized": 0.05, "negative_control_separation": 0.10, "canonical_prototype_bonus": 0.10,
    },
    "bridge": {
        "adjacent_pool_size": 0.12, "adjacent_unique_systems": 0.18, "adjacent_element_overlap": 0.18, "adjacent_family_entropy": 0.12,
        "adjacent_prototype_entropy": 0.15, "adjacent_variant_entropy": 0.10, "cross_pool_overlap": 0.05, "negative_control_separation": 0.10,
    },
    "boundary": {
        "boundary_pool_size": 0.10, "same_formula_or_prototype_context": 0.20, "different_spacegroup": 0.18, "different_crystal_system": 0.12,
        "different_structure_variant": 0.15, "symmetry_distance": 0.12, "symmetry_entropy": 0.05, "boundary_stability": 0.08,
    },
    "outlier": {"low_same_family_support": 0.25, "low_adjacent_support": 0.20, "negative_control_similarity": 0.20, "low_family_match": 0.20, "high_missingness": 0.15},
}
PENALTY, PENALTY_CAP, CANONICAL_PENALTY = 0.035, 0.25, 0.16
LEAKAGE = ("same_chemical_system_rate", "same_composition_family_rate", "same_material_family_rate", "same_formula_family_rate", "same_prototype_family_rate", "same_structure_variant_rate", "mean_element_overlap_fraction")
#: target sizes of the pools, for completeness
FULL = {"same_family": 500, "adjacent_family": 500, "boundary_contrast": 500, "wildcard": 100, "negative_control": 100}


def by_query(metrics: DataFrame) -> DataFrame:
    """One row per query with a struct of metrics for each pool; absent pools are null."""
    fields = [c for c in metrics.columns if c not in ("query_id", "pool_name")]
    return metrics.groupBy("query_id").agg(*[F.max(F.when(F.col("pool_name") == p, F.struct(*fields))).alias(p) for p in POOLS])


def named_concepts(wide: DataFrame, independence: DataFrame, missing: DataFrame) -> DataFrame:
    """The named evidence concepts of every query, one wide row each.

    ``wide`` comes from :func:`by_query`, ``independence`` has in_several_pools
    and unique_candidates, ``missing`` a ``missing_rate`` per query and pool.
    """
    p = lambda pool, m: F.col(f"{pool}.{m}").cast("double")
    rates = missing.groupBy("query_id").agg(*[F.avg(F.when(F.col("pool_name") == q, F.col("missing_rate"))).alias(f"missing_{q}") for q in POOLS])
    rows = wide.join(independence.select("query_id", "in_several_pools", "unique_candidates"), "query_id", "left").join(rates, "query_id", "left")
    sf, ad, bo, wi, ne = POOLS
    similarity = {q: p(q, "query_similarity_score") for q in (sf, ad, bo, wi)}
    one = lambda c: F.lit(1.0) - F.coalesce(c, F.lit(0.0))
    count = lambda q, n: clip01(F.coalesce(p(q, "n_candidates"), F.lit(0.0)) / n)
    first = rows.withColumns(
        {
            "same_family_density": count(sf, 50),
            "adjacent_pool_density": count(ad, 50),
            "boundary_pool_density": count(bo, 50),
            "same_family_coherence": mean_available(*[p(sf, f"same_{x}_rate") for x in ("composition_family", "material_family", "formula_family", "prototype_family", "structure_variant")]),
            "same_family_structural_coherence": mean_available(*[p(sf, f"same_{x}_rate") for x in ("prototype_family", "structure_variant", "spacegroup", "crystal_system")]),
            "adjacent_family_diversity": mean_available(*[p(ad, f"{x}_entropy") for x in ("composition_family", "material_family", "formula_family", "prototype_family", "structure_variant")]),
            "adjacent_relatedness": mean_available(p(ad, "mean_element_overlap_fraction"), *[p(ad, f"same_{x}_rate") for x in ("material_family", "formula_family", "prototype_family")]),
            "adjacent_unique_systems": clip01(F.coalesce(p(ad, "chemical_system_count"), F.lit(0.0)) / 10),
            "balanced_multi_pool_similarity": mean_available(balance_by_ratio(similarity[sf], similarity[ad]), balance_by_ratio(similarity[ad], similarity[bo])),
            "competing_membership_strength": mean_available(entropy_of(list(similarity.values()), zeros_count=True), F.greatest(*similarity.values()), similarity[ad]),
            "boundary_symmetry_diversity": mean_available(p(bo, "spacegroup_number_entropy"), p(bo, "crystal_system_code_entropy")),
            "boundary_symmetry_distance": clip01(F.coalesce(p(bo, "mean_symmetry_distance"), F.lit(0.0)) / 100),
            "boundary_context_preservation": mean_available(*[p(bo, f"same_{x}_rate") for x in ("formula_family", "prototype_family", "structure_variant")]),
            "negative_control_separation": F.lit(1.0) - clip01(F.greatest(*[F.coalesce(p(ne, m), F.lit(0.0)) for m in LEAKAGE])),
            "pool_overlap_rate": F.coalesce(F.try_divide(F.col("in_several_pools").cast("double"), F.nullif(F.col("unique_candidates").cast("double"), F.lit(0.0))), F.lit(0.0)),
            "missingness_rate": mean_available(*[F.col(f"missing_{q}") for q in POOLS]),
            "stability_support": mean_available(*[p(q, "stable_fraction") for q in POOLS[:4]]),
            "synthesis_support": mean_available(*[p(q, "known_synthesized_rate") for q in POOLS[:4]]),
        }
    )
    c = F.col
    between = mean_available(closeness(similarity[ad], mean_available(similarity[sf], similarity[bo]), 0.40), similarity[ad])
    second = first.withColumns(
        {
            "structural_interpolation_score": mean_available(balance_by_ratio(similarity[sf], similarity[bo]), between, p(ad, "structural_metadata_similarity_score"), p(bo, "structural_regime_diversity_score")),
            "coordination_transition_proxy": mean_available(p(ad, "structural_regime_diversity_score"), p(bo, "structural_regime_diversity_score"), c("adjacent_relatedness"), p(bo, "structural_metadata_similarity_score")),
            "boundary_contrast_strength": mean_available(
                c("boundary_pool_density"), F.lit(1.0) - clip01(p(bo, "same_spacegroup_rate")), F.lit(1.0) - clip01(p(bo, "same_crystal_system_rate")), c("boundary_symmetry_diversity"), c("boundary_symmetry_distance"), c("boundary_context_preservation")
            ),
        }
    )
    bridge = ["adjacent_pool_density", "adjacent_family_diversity", "adjacent_relatedness", "adjacent_unique_systems", "balanced_multi_pool_similarity", "competing_membership_strength", "structural_interpolation_score", "coordination_transition_proxy"]
    third = second.withColumn("bridge_evidence_entropy", entropy_of([c(b) for b in bridge], zeros_count=True))
    tail = (one(c("missingness_rate")), c("stability_support"))
    fourth = third.withColumns(
        {
            "hub_strength_evidence": mean_available(c("same_family_density"), c("same_family_coherence"), c("same_family_structural_coherence"), c("negative_control_separation"), one(c("pool_overlap_rate")), *tail),
            "bridge_strength_evidence": mean_available(*[c(b) for b in bridge], c("bridge_evidence_entropy"), *tail),
            "boundary_strength_evidence": mean_available(*[c(b) for b in ("boundary_pool_density", "boundary_contrast_strength", "boundary_symmetry_diversity", "boundary_symmetry_distance", "boundary_context_preservation")], *tail),
        }
    )
    roles = ("hub_strength_evidence", "bridge_strength_evidence", "boundary_strength_evidence")
    ordered = F.sort_array(F.array_compact(F.array(*[c(r) for r in roles])), asc=False)
    fifth = fourth.withColumns({"core_role_strength_max": F.greatest(*[c(r) for r in roles]), "core_role_strength_mean": mean_available(*[c(r) for r in roles]), "role_ambiguity_risk": F.lit(1.0) - clip01((F.get(ordered, 0) - F.get(ordered, 1)) / 0.30)})
    sixth = fifth.withColumn("no_strong_role_risk", clip01(F.lit(1.0) - c("core_role_strength_max")))
    last = sixth.withColumns(
        {
            "possible_outlier_flag_evidence": mean_available(c("no_strong_role_risk"), one(c("same_family_density")), one(c("adjacent_pool_density")), one(c("boundary_pool_density")), one(c("negative_control_separation")), c("missingness_rate")),
            "overall_named_evidence_strength": mean_available(*[c(x) for x in ("same_family_density", "same_family_coherence", "adjacent_pool_density", "adjacent_family_diversity", "boundary_pool_density", "boundary_contrast_strength", "negative_control_separation")], one(c("missingness_rate"))),
        }
    )
    names = [x for x in last.columns if x not in (*wide.columns, "in_several_pools", "unique_candidates", *[f"missing_{q}" for q in POOLS])]
    return last.select("query_id", *names)


def long_concepts(concepts: DataFrame) -> DataFrame:
    """``query_id``, ``concept``, ``value``: one row per query and concept."""
    names = [c for c in concepts.columns if c != "query_id"]
    return concepts.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("concept"), F.col(n).alias("value")) for n in names])).alias("x")).select("query_id", "x.concept", "x.value")


def _canonical(prototype: Column, variant: Column, spacegroup: Column) -> Column:
    """Canonical cubic prototypes, whose contrast pools hold their own lower-symmetry variants."""
    proto, var = F.lower(F.trim(prototype)), F.lower(F.trim(variant))
    spinel = proto.isin("spinel_like", "spinel", "normal_spinel", "inverse_spinel") & (F.coalesce(spacegroup == 227, F.lit(False)) | F.contains(var, F.lit("cubic")))
    return F.coalesce(spinel | (proto.isin("perovskite_like", "fluorite_related") & F.contains(var, F.lit("cubic"))), F.lit(False))


def role_scores(wide: DataFrame, queries: DataFrame, overlaps: DataFrame, independence: DataFrame, missing: DataFrame) -> DataFrame:
    """Scores, confidence, support and the context decision of every query, one wide row each.

    ``queries`` carries ``q_formula_family``, ``q_prototype_family``,
    ``q_structure_variant`` and ``q_spacegroup_number``. Absent metrics count 0.
    """
    sf, ad, bo, wi, ne = POOLS
    g = lambda pool, m: number_or(F.col(f"{pool}.{m}"))
    shared = overlaps.filter(F.array_contains(F.array("pool_a", "pool_b"), sf) & F.array_contains(F.array("pool_a", "pool_b"), ad)).groupBy("query_id").agg(F.sum("shared").alias("same_adjacent"))
    rates = missing.groupBy("query_id").agg(F.avg("missing_rate").alias("missing_all"), *[F.avg(F.when(F.col("pool_name") == q, F.col("missing_rate"))).alias(f"missing_{q}") for q in POOLS])
    side = queries.select("query_id", "q_formula_family", "q_prototype_family", "q_structure_variant", "q_spacegroup_number")
    rows = wide.join(side, "query_id", "left").join(shared, "query_id", "left").join(rates, "query_id", "left").join(independence.select("query_id", "in_several_pools", "unique_candidates", "entries"), "query_id", "left")
    c = F.col
    base = rows.withColumns(
        {
            "separation": F.lit(1.0) - clip01_or_zero(F.greatest(*[g(ne, m) for m in LEAKAGE])),
            "overlap_count": F.coalesce(c("same_adjacent").cast("double"), F.lit(0.0)),
            "missing_rate": F.coalesce("missing_all", F.lit(0.0)),
            "family_specificity": label_specificity(c("q_formula_family"), F.coalesce("q_prototype_family", F.lit("")), F.coalesce("q_structure_variant", F.lit(""))),
            "structural_specificity": label_specificity(None, F.coalesce("q_prototype_family", F.lit("")), F.coalesce("q_structure_variant", F.lit(""))),
            "canonical": _canonical(c("q_prototype_family"), c("q_structure_variant"), c("q_spacegroup_number")),
            "context_strength": clip01_or_zero(F.greatest(g(sf, "same_formula_family_rate"), g(sf, "same_prototype_family_rate"), g(sf, "same_structure_variant_rate"), g(sf, "stable_fraction"))),
        }
    )
    best = F.greatest(g(sf, "same_formula_family_rate"), g(sf, "same_prototype_family_rate"), g(bo, "same_formula_family_rate"), g(bo, "same_prototype_family_rate"))
    base = base.withColumn("anchor", clip01_or_zero(best * (F.lit(0.45) + F.lit(0.55) * c("family_specificity"))))
    family_entropy = F.greatest(*[g(ad, f"{x}_entropy") for x in ("composition_family", "material_family", "formula_family")])
    context = F.greatest(g(bo, "same_formula_family_rate"), g(bo, "same_prototype_family_rate"))
    components: Mapping[str, Mapping[str, Column]] = {
        "hub": {
            "same_family_pool_size": norm_count(g(sf, "n_candidates"), 500),
            "same_composition_match": g(sf, "same_composition_family_rate"),
            "same_material_match": g(sf, "same_material_family_rate"),
            "same_formula_match": g(sf, "same_formula_family_rate"),
            "same_prototype_match": g(sf, "same_prototype_family_rate"),
            "same_family_stable_fraction": g(sf, "stable_fraction"),
            "same_family_known_synthesized": g(sf, "known_synthesized_rate"),
            "negative_control_separation": c("separation"),
            "canonical_prototype_bonus": c("canonical").cast("double"),
        },
        "bridge": {
            "adjacent_pool_size": norm_count(g(ad, "n_candidates"), 500),
            "adjacent_unique_systems": norm_count(g(ad, "chemical_system_count"), 100),
            "adjacent_element_overlap": g(ad, "mean_element_overlap_fraction"),
            "adjacent_family_entropy": family_entropy,
            "adjacent_prototype_entropy": g(ad, "prototype_family_entropy"),
            "adjacent_variant_entropy": g(ad, "structure_variant_entropy"),
            "cross_pool_overlap": norm_count(c("overlap_count"), 100),
            "negative_control_separation": c("separation"),
        },
        "boundary": {
            "boundary_pool_size": norm_count(g(bo, "n_candidates"), 500),
            "same_formula_or_prototype_context": context,
            "different_spacegroup": F.lit(1.0) - g(bo, "same_spacegroup_rate"),
            "different_crystal_system": F.lit(1.0) - g(bo, "same_crystal_system_rate"),
            "different_structure_variant": F.lit(1.0) - g(bo, "same_structure_variant_rate"),
            "symmetry_distance": norm_count(g(bo, "mean_symmetry_distance"), 100),
            "symmetry_entropy": F.greatest(g(bo, "spacegroup_number_entropy"), g(bo, "crystal_system_code_entropy"), g(bo, "structure_variant_entropy")),
            "boundary_stability": g(bo, "stable_fraction"),
        },
        "outlier": {
            "low_same_family_support": F.lit(1.0) - norm_count(g(sf, "n_candidates"), 500),
            "low_adjacent_support": F.lit(1.0) - norm_count(g(ad, "n_candidates"), 500),
            "negative_control_similarity": F.lit(1.0) - c("separation"),
            "low_family_match": F.lit(1.0) - g(sf, "same_composition_family_rate"),
            "high_missingness": c("missing_rate"),
        },
    }
    canonical_penalty = c("canonical") & (c("context_strength") >= 0.80)
    spread = F.greatest(family_entropy, g(ad, "prototype_family_entropy"), g(ad, "structure_variant_entropy"))
    objections = {
        "hub": (g(ad, "chemical_system_count") > 150, c("overlap_count") > 0, (g(sf, "same_formula_family_rate") < 0.60) & (g(sf, "same_prototype_family_rate") < 0.60)),
        "bridge": (spread <= 0.05, g(ad, "mean_element_overlap_fraction") < 0.30),
        "boundary": (g(bo, "stable_fraction") < 0.50, g(bo, "same_spacegroup_rate") > 0.50, context < 0.30, canonical_penalty),
        "outlier": (g(sf, "n_candidates") >= 100, g(ad, "n_candidates") >= 100, c("separation") > 0.80),
    }
    raw = base.withColumns({f"{r}_raw": weighted_score(components[r], w) for r, w in ROLE_WEIGHTS.items()} | {f"{r}_contradictions": sum((x.cast("int") for x in (*objections[r], c("missing_rate") > 0.25)), F.lit(0)) for r in ROLE_WEIGHTS})
    raw = raw.withColumn("boundary_raw", F.when(canonical_penalty, F.greatest(c("boundary_raw") - CANONICAL_PENALTY, F.lit(0.0))).otherwise(c("boundary_raw")))
    needs = {"hub": (sf, ne), "bridge": (ad, sf, ne), "boundary": (bo, sf), "outlier": (sf, ad, ne, wi)}

    def quality(pools: tuple[str, ...]) -> Column:
        """0.45 filled pools + 0.35 (1 - mean missing rate) + 0.20; of the pools that exist."""
        present = sum((c(q).isNotNull().cast("int") for q in pools), F.lit(0))
        filled = sum(((g(q, "n_candidates") > 0) & c(q).isNotNull()).cast("int") for q in pools)
        missing_mean = F.coalesce(mean_available(*[c(f"missing_{q}") for q in pools]), F.lit(0.0))
        return F.when(present == 0, 0.0).otherwise(clip01_or_zero(F.lit(0.45) * filled / F.greatest(present, F.lit(1)) + F.lit(0.35) * (F.lit(1.0) - clip01_or_zero(missing_mean)) + 0.20))

    scored = raw.withColumns(
        {f"{r}_score": F.round(clip01_or_zero(c(f"{r}_raw") - F.least(F.lit(PENALTY_CAP), F.lit(PENALTY) * c(f"{r}_contradictions"))), 6) for r in ROLE_WEIGHTS} | {f"{r}_base": F.round(quality(needs[r]), 6) for r in ROLE_WEIGHTS} | {"quality": quality(POOLS)}
    )

    def confidence(r: str, gap: Column) -> Column:
        return F.round(role_confidence(c(f"{r}_base"), c(f"{r}_score"), c(f"{r}_contradictions"), c("family_specificity"), c("structural_specificity"), c("anchor"), gap, c("missing_rate")), 6)

    first = scored.withColumns({f"{r}_first": confidence(r, F.lit(0.0)) for r in ROLE_WEIGHTS})
    core = F.array_max(F.array(*[F.struct(c(f"{r}_score").alias("s"), c(f"{r}_first").alias("k"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, r in enumerate(("hub", "boundary"))]))
    top = F.array_max(F.array(*[F.struct(c(f"{r}_score").alias("s"), c(f"{r}_first").alias("k"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, r in enumerate(("hub", "boundary", "bridge", "outlier"))]))
    judged = first.withColumns({"core": core, "top_role": top["r"], "role_gap": F.abs(c("hub_score") - c("boundary_score"))})
    entries = F.greatest(sum((g(q, "n_candidates") for q in POOLS), F.lit(0.0)), F.lit(1.0))
    parts = ((0.25, c("anchor")), (0.20, c("structural_specificity")), (0.15, c("separation")), (0.15, c("quality")), (0.10, clip01_or_zero(c("role_gap") / 0.08)), (0.10, F.lit(1.0) - clip01_or_zero(c("missing_rate"))), (0.05, F.lit(1.0) - clip01_or_zero(F.coalesce("in_several_pools", F.lit(0)) / entries)))
    generic = (c("family_specificity") < 0.25) | (c("structural_specificity") < 0.40) | (c("anchor") < 0.40)
    strong = (c("core.s") >= 0.70) & (c("core.k") >= 0.60)
    suff = judged.withColumns({"sufficiency_raw": clip01_or_zero(sum((F.lit(w) * v for w, v in parts), F.lit(0.0))), "generic_overclaim_risk": generic, "strong_core": strong})
    suff = suff.withColumn("sufficiency", F.when(generic & ~strong, F.least(c("sufficiency_raw"), F.lit(0.54))).otherwise(c("sufficiency_raw")))
    suff = suff.withColumn("status", F.when(c("sufficiency") >= 0.55, "sufficient").when(c("strong_core"), "sufficient_with_caution").otherwise("insufficient"))
    final = suff.withColumns({f"{r}_confidence": confidence(r, F.when(c("top_role") == r, c("role_gap")).otherwise(0.0)) for r in ROLE_WEIGHTS})
    support = {}
    for r in ROLE_WEIGHTS:
        label = context_gate(r, plausibility(c(f"{r}_score"), c(f"{r}_confidence")), c(f"{r}_score"), c("family_specificity"), c("structural_specificity"), c("anchor"))
        if r != "outlier":
            kept = ((c(f"{r}_score") >= 0.70) & (c(f"{r}_confidence") >= 0.60)) if r in ("hub", "boundary") else F.lit(False)
            label = F.when((c("status") == "insufficient") & ~kept, "not_supported_due_to_insufficient_context").otherwise(label)
        support[f"{r}_plausibility"] = label
    final = final.withColumns(support | {f"{r}_band": strength_band(c(f"{r}_score"), c(f"{r}_confidence"), c("status")) for r in ("hub", "boundary")})
    defensible = lambda r: c(f"{r}_band").isin("moderate", "strong", "very_strong")
    best_core = F.when(F.struct("hub_score", "hub_confidence") >= F.struct(c("boundary_score").alias("hub_score"), c("boundary_confidence").alias("hub_confidence")), "hub").otherwise("boundary")
    primary = F.when(defensible("hub") | defensible("boundary"), best_core).otherwise("other")
    ambiguity = clip01_or_zero(F.lit(1.0) - c("role_gap") / 0.25)
    rate = F.coalesce(F.try_divide(c("in_several_pools").cast("double"), F.nullif(c("unique_candidates").cast("double"), F.lit(0.0))), F.lit(0.0))
    completeness = mean_available(*[F.least(g(q, "n_candidates") / float(FULL[q]), F.lit(1.0)) for q in POOLS if q != wi])
    done = final.withColumns({"primary_role": primary, "ambiguous": c("role_gap") < 0.08, "context_ambiguity": F.round(ambiguity, 6), "pool_independence": F.round(F.lit(1.0) - clip01_or_zero(rate), 6), "retrieval_completeness": F.round(completeness, 6)})
    done = done.withColumn("profile_confidence", F.round(profile_confidence(F.round(c("sufficiency"), 6), c("retrieval_completeness"), c("pool_independence"), c("context_ambiguity"), c("hub_confidence"), c("boundary_confidence")), 6))
    done = done.withColumn("contextual_pattern", contextual_pattern(c("hub_score"), c("boundary_score"), c("profile_confidence"), c("status")))
    return done.select(
        "query_id",
        *[f"{r}_{x}" for r in ROLE_WEIGHTS for x in ("score", "contradictions", "confidence", "plausibility")],
        "hub_band",
        "boundary_band",
        F.round("sufficiency", 6).alias("sufficiency"),
        F.round("anchor", 6).alias("anchor"),
        "status",
        "generic_overclaim_risk",
        "primary_role",
        F.when(c("primary_role") == "hub", c("hub_score")).when(c("primary_role") == "boundary", c("boundary_score")).alias("primary_score"),
        "ambiguous",
        "context_ambiguity",
        "pool_independence",
        "retrieval_completeness",
        "profile_confidence",
        "contextual_pattern",
    )


def bridge_diagnostics(wide: DataFrame) -> DataFrame:
    """Bridge diagnostics of the scoring stage, by formulas that differ from the named concepts."""
    sf, ad, bo, wi, _ = POOLS
    g = lambda pool, m: number_or(F.col(f"{pool}.{m}"))
    s = {q: g(q, "query_similarity_score") for q in (sf, ad, bo, wi)}
    one = wide.select(
        "query_id",
        mean_clipped(balance_by_gap(s[sf], s[ad]), balance_by_gap(s[ad], s[bo])).alias("balanced"),
        mean_clipped(entropy_of(list(s.values()), zeros_count=False), F.greatest(*s.values()), s[ad]).alias("competing"),
        mean_clipped(balance_by_gap(s[sf], s[bo]), s[ad], g(ad, "structural_metadata_similarity_score"), g(bo, "structural_regime_diversity_score")).alias("interpolation"),
        mean_clipped(g(ad, "structural_regime_diversity_score"), g(bo, "structural_regime_diversity_score"), g(ad, "mean_element_overlap_fraction"), g(bo, "structural_metadata_similarity_score")).alias("transition"),
    )
    return one.withColumn("bridge_strength", mean_clipped(*[F.col(x) for x in ("balanced", "competing", "interpolation", "transition")]))
