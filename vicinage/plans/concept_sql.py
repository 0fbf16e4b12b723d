"""SQL of the evidence concepts and bridge diagnostics, from the pools on."""

from __future__ import annotations

from vicinage.functions.scores import GENERIC_LABELS, STRENGTH_STEPS
from vicinage.operators import cohort as H
from vicinage.operators.retrieval import POOLS
from vicinage.operators.roles import LEAKAGE
from vicinage.plans import retrieval_queries as P

SHORT = dict(zip(POOLS, ("sf", "ad", "bo", "wi", "ne")))
RATES = ("composition_family", "material_family", "formula_family", "prototype_family", "structure_variant")


def _clip(v: str) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN least(greatest(({v}), 0.0), 1.0) END"


def _zero(v: str) -> str:
    return f"coalesce({_clip(v)}, 0.0)"


def _one(v: str) -> str:
    return f"(1 - coalesce({v}, 0.0))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN greatest({a}, {b}) <= 0 THEN 0.0 ELSE {_clip(f'({a} + {b}) / 2 * least({a}, {b}) / greatest({a}, {b})')} END"


def _gap(a: str, b: str) -> str:
    return f"(least({_zero(a)}, {_zero(b)}) * (1 - abs({_zero(a)} - {_zero(b)})))"


def _entropy(values: list[str], *, zeros: bool) -> str:
    kept = f"list_filter([{', '.join(f'({v})::DOUBLE' for v in values)}], lambda v: v IS NOT NULL AND v {'>=' if zeros else '>'} 0)"
    total = f"list_sum({kept})"
    bits = f"-list_sum(list_transform(list_filter({kept}, lambda v: v > 0), lambda v: v / {total} * log2(v / {total})))"
    return f"CASE WHEN len({kept}) = 0 THEN {'NULL' if zeros else '0.0'} WHEN len({kept}) = 1 OR {total} <= 0 THEN 0.0 ELSE {bits} / log2(len({kept})) END"


def _mean_zero(*values: str) -> str:
    return "(" + " + ".join(_zero(v) for v in values) + f") / {len(values)}"


def _wide(metrics: list[str]) -> str:
    ctes, rows = P.metrics_ctes()
    columns = ", ".join(f"max({m}::DOUBLE) FILTER (pool_name = '{p}') AS {s}_{m}" for p, s in SHORT.items() for m in metrics)
    return f"{ctes}, wide AS MATERIALIZED (SELECT query_id, {columns} FROM ({rows}) GROUP BY 1)"


def bridge_sql() -> str:
    names = ["query_similarity_score", "structural_metadata_similarity_score", "structural_regime_diversity_score", "mean_element_overlap_fraction"]
    s = {k: f"coalesce({k}_query_similarity_score, 0.0)" for k in ("sf", "ad", "bo", "wi")}
    parts = {
        "balanced": _mean_zero(_gap(s["sf"], s["ad"]), _gap(s["ad"], s["bo"])),
        "competing": _mean_zero(_entropy(list(s.values()), zeros=False), f"greatest({', '.join(s.values())})", s["ad"]),
        "interpolation": _mean_zero(_gap(s["sf"], s["bo"]), s["ad"], "ad_structural_metadata_similarity_score", "bo_structural_regime_diversity_score"),
        "transition": _mean_zero("ad_structural_regime_diversity_score", "bo_structural_regime_diversity_score", "ad_mean_element_overlap_fraction", "bo_structural_metadata_similarity_score"),
    }
    return f"{_wide(names)}, bd AS (SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in parts.items())} FROM wide) SELECT query_id, {', '.join(f'round({k}, 6) AS {k}' for k in parts)}, round((balanced + competing + interpolation + transition) / 4, 6) AS bridge_strength FROM bd"


def concepts_sql() -> str:
    names = ["n_candidates", "query_similarity_score", "structural_metadata_similarity_score", "structural_regime_diversity_score", "mean_element_overlap_fraction", "mean_symmetry_distance", "chemical_system_count", "stable_fraction", "known_synthesized_rate", "spacegroup_number_entropy", "crystal_system_code_entropy"]
    names += [f"same_{x}_rate" for x in (*RATES, "spacegroup", "crystal_system")] + [f"{x}_entropy" for x in RATES]
    names += [m for m in LEAKAGE if m not in names]
    mean = P._mean
    sim = {k: f"{k}_query_similarity_score" for k in ("sf", "ad", "bo", "wi")}
    density = lambda k: _clip(f"coalesce({k}_n_candidates, 0.0) / 50")
    rates = " UNION ALL ".join(f"SELECT query_id, pool_name, {f'(count(*) - count({c})) / count(*)' if c != 'n_symmetry_ops' else '1.0'} AS r FROM p GROUP BY 1, 2" for c in P.REPORTED)
    levels: list[dict[str, str]] = [
        {
            "same_family_density": density("sf"),
            "adjacent_pool_density": density("ad"),
            "boundary_pool_density": density("bo"),
            "same_family_coherence": mean(*[f"sf_same_{x}_rate" for x in RATES]),
            "same_family_structural_coherence": mean(*[f"sf_same_{x}_rate" for x in ("prototype_family", "structure_variant", "spacegroup", "crystal_system")]),
            "adjacent_family_diversity": mean(*[f"ad_{x}_entropy" for x in RATES]),
            "adjacent_relatedness": mean("ad_mean_element_overlap_fraction", *[f"ad_same_{x}_rate" for x in ("material_family", "formula_family", "prototype_family")]),
            "adjacent_unique_systems": _clip("coalesce(ad_chemical_system_count, 0.0) / 10"),
            "balanced_multi_pool_similarity": mean(_ratio(sim["sf"], sim["ad"]), _ratio(sim["ad"], sim["bo"])),
            "competing_membership_strength": mean(_entropy(list(sim.values()), zeros=True), f"greatest({', '.join(sim.values())})", sim["ad"]),
            "boundary_symmetry_diversity": mean("bo_spacegroup_number_entropy", "bo_crystal_system_code_entropy"),
            "boundary_symmetry_distance": _clip("coalesce(bo_mean_symmetry_distance, 0.0) / 100"),
            "boundary_context_preservation": mean(*[f"bo_same_{x}_rate" for x in ("formula_family", "prototype_family", "structure_variant")]),
            "negative_control_separation": f"1 - {_clip('greatest(' + ', '.join(f'coalesce(ne_{m}, 0.0)' for m in LEAKAGE) + ')')}",
            "pool_overlap_rate": "coalesce(several / nullif(uniq, 0), 0.0)",
            "missingness_rate": mean(*[f"mi_{k}" for k in SHORT.values()]),
            "stability_support": mean(*[f"{k}_stable_fraction" for k in ("sf", "ad", "bo", "wi")]),
            "synthesis_support": mean(*[f"{k}_known_synthesized_rate" for k in ("sf", "ad", "bo", "wi")]),
        }
    ]
    middle = mean(sim["sf"], sim["bo"])
    near = sim["ad"]
    close = f"CASE WHEN {near} IS NOT NULL AND {middle} IS NOT NULL THEN {_clip(f'1 - abs({near} - {middle}) / 0.4')} END"
    levels.append(
        {
            "structural_interpolation_score": mean(_ratio(sim["sf"], sim["bo"]), mean(close, sim["ad"]), "ad_structural_metadata_similarity_score", "bo_structural_regime_diversity_score"),
            "coordination_transition_proxy": mean("ad_structural_regime_diversity_score", "bo_structural_regime_diversity_score", "adjacent_relatedness", "bo_structural_metadata_similarity_score"),
            "boundary_contrast_strength": mean("boundary_pool_density", f"1 - {_clip('bo_same_spacegroup_rate')}", f"1 - {_clip('bo_same_crystal_system_rate')}", "boundary_symmetry_diversity", "boundary_symmetry_distance", "boundary_context_preservation"),
        }
    )
    bridge = ["adjacent_pool_density", "adjacent_family_diversity", "adjacent_relatedness", "adjacent_unique_systems", "balanced_multi_pool_similarity", "competing_membership_strength", "structural_interpolation_score", "coordination_transition_proxy"]
    levels.append({"bridge_evidence_entropy": _entropy(bridge, zeros=True)})
    tail = (_one("missingness_rate"), "stability_support")
    levels.append(
        {
            "hub_strength_evidence": mean("same_family_density", "same_family_coherence", "same_family_structural_coherence", "negative_control_separation", _one("pool_overlap_rate"), *tail),
            "bridge_strength_evidence": mean(*bridge, "bridge_evidence_entropy", *tail),
            "boundary_strength_evidence": mean("boundary_pool_density", "boundary_contrast_strength", "boundary_symmetry_diversity", "boundary_symmetry_distance", "boundary_context_preservation", *tail),
        }
    )
    roles = "hub_strength_evidence, bridge_strength_evidence, boundary_strength_evidence"
    falling = f"list_sort(list_filter([{roles}], lambda v: v IS NOT NULL), 'DESC')"
    levels.append({"core_role_strength_max": f"greatest({roles})", "core_role_strength_mean": mean(*roles.split(", ")), "role_ambiguity_risk": f"1 - {_clip(f'({falling}[1] - {falling}[2]) / 0.3')}"})
    levels.append({"no_strong_role_risk": _clip("1 - core_role_strength_max")})
    levels.append(
        {
            "possible_outlier_flag_evidence": mean("no_strong_role_risk", *[_one(x) for x in ("same_family_density", "adjacent_pool_density", "boundary_pool_density", "negative_control_separation")], "missingness_rate"),
            "overall_named_evidence_strength": mean("same_family_density", "same_family_coherence", "adjacent_pool_density", "adjacent_family_diversity", "boundary_pool_density", "boundary_contrast_strength", "negative_control_separation", _one("missingness_rate")),
        }
    )
    ctes = [
        _wide(names),
        f"mr AS (SELECT query_id, {', '.join(f'''avg(r) FILTER (pool_name = '{p}') AS mi_{s}''' for p, s in SHORT.items())} FROM ({rates}) GROUP BY 1)",
        "io AS (SELECT query_id, count(*) AS uniq, sum((k > 1)::INT) AS several FROM (SELECT query_id, candidate_id, count(DISTINCT pool_name) AS k FROM p GROUP BY 1, 2) GROUP BY 1)",
        "n0 AS (SELECT wide.*, mr.* EXCLUDE (query_id), io.* EXCLUDE (query_id) FROM wide LEFT JOIN mr USING (query_id) LEFT JOIN io USING (query_id))",
    ]
    for i, level in enumerate(levels):
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT *, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in level.items())} FROM n{i})")
    last = f"n{len(levels)}"
    return ",\n".join(ctes) + "\n" + " UNION ALL ".join(f"SELECT query_id, '{c}' AS concept, round({c}, 6) AS value FROM {last}" for level in levels for c in level)


def roles_sql() -> str:
    ctes, rows = _roles()
    return f"{ctes}\n{rows}"


def _roles(more: tuple[str, ...] = ()) -> tuple[str, str]:
    """CTEs up to the parts of the scores, and the SELECT of the scores; ``wide`` also holds the metrics ``more``."""
    names = ["n_candidates", "chemical_system_count", "mean_element_overlap_fraction", "mean_symmetry_distance", "stable_fraction", "known_synthesized_rate", "spacegroup_number_entropy", "crystal_system_code_entropy"]
    names += [f"same_{x}_rate" for x in (*RATES, "spacegroup", "crystal_system")] + [f"{x}_entropy" for x in RATES]
    names += [m for m in (*LEAKAGE, *more) if m not in names]
    g = lambda k, m: f"coalesce({k}_{m}, 0.0)"
    most = lambda *v: f"greatest({', '.join(v)})"
    share = lambda v, n: _zero(f"({v}) / {n}")
    rates = " UNION ALL ".join(f"SELECT query_id, pool_name, {f'(count(*) - count({c})) / count(*)' if c != 'n_symmetry_ops' else '1.0'} AS r FROM p GROUP BY 1, 2" for c in P.REPORTED)

    def specific(*labels: tuple[str, float]) -> str:
        listed = ", ".join(f"'{v}'" for v in GENERIC_LABELS)
        one = lambda c, w: f"CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN ({listed}) AND NOT starts_with(lower(trim({c})), 'unknown') THEN {w} ELSE 0.0 END"
        return f"least(1.0, {' + '.join(one(c, w) for c, w in labels)})"

    proto, var = "lower(trim(q_prototype_family))", "lower(trim(q_structure_variant))"
    first = {
        "sep": f"1 - {_zero(most(*[g('ne', m) for m in LEAKAGE]))}",
        "ovc": "coalesce(shared, 0)::DOUBLE",
        "mis": "coalesce(mi_all, 0.0)",
        "fspec": specific(("q_formula_family", 0.35), ("q_prototype_family", 0.45), ("q_structure_variant", 0.20)),
        "sspec": specific(("q_prototype_family", 0.45), ("q_structure_variant", 0.20)),
        "canon": f"coalesce(({proto} IN ('spinel_like', 'spinel', 'normal_spinel', 'inverse_spinel') AND (coalesce(q_spacegroup_number = 227, false) OR contains({var}, 'cubic'))) OR ({proto} IN ('perovskite_like', 'fluorite_related') AND contains({var}, 'cubic')), false)",
        "cstr": _zero(most(g("sf", "same_formula_family_rate"), g("sf", "same_prototype_family_rate"), g("sf", "same_structure_variant_rate"), g("sf", "stable_fraction"))),
        "ctx": most(g("bo", "same_formula_family_rate"), g("bo", "same_prototype_family_rate")),
        "fent": most(*[g("ad", f"{x}_entropy") for x in ("composition_family", "material_family", "formula_family")]),
    }
    best = most(g("sf", "same_formula_family_rate"), g("sf", "same_prototype_family_rate"), "ctx")
    second = {"anchor": _zero(f"{best} * (0.45 + 0.55 * fspec)"), "pen": "canon AND cstr >= 0.8", "spread": most("fent", g("ad", "prototype_family_entropy"), g("ad", "structure_variant_entropy"))}
    parts = {
        "hub": [(0.15, share(g("sf", "n_candidates"), 500)), (0.10, g("sf", "same_composition_family_rate")), (0.10, g("sf", "same_material_family_rate")), (0.20, g("sf", "same_formula_family_rate")), (0.20, g("sf", "same_prototype_family_rate")), (0.10, g("sf", "stable_fraction")), (0.05, g("sf", "known_synthesized_rate")), (0.10, "sep"), (0.10, "canon::INT")],
        "bridge": [(0.12, share(g("ad", "n_candidates"), 500)), (0.18, share(g("ad", "chemical_system_count"), 100)), (0.18, g("ad", "mean_element_overlap_fraction")), (0.12, "fent"), (0.15, g("ad", "prototype_family_entropy")), (0.10, g("ad", "structure_variant_entropy")), (0.05, share("ovc", 100)), (0.10, "sep")],
        "boundary": [(0.10, share(g("bo", "n_candidates"), 500)), (0.20, "ctx"), (0.18, f"1 - {g('bo', 'same_spacegroup_rate')}"), (0.12, f"1 - {g('bo', 'same_crystal_system_rate')}"), (0.15, f"1 - {g('bo', 'same_structure_variant_rate')}"), (0.12, share(g("bo", "mean_symmetry_distance"), 100)), (0.05, most(g("bo", "spacegroup_number_entropy"), g("bo", "crystal_system_code_entropy"), g("bo", "structure_variant_entropy"))), (0.08, g("bo", "stable_fraction"))],
        "outlier": [(0.25, f"1 - {share(g('sf', 'n_candidates'), 500)}"), (0.20, f"1 - {share(g('ad', 'n_candidates'), 500)}"), (0.20, "1 - sep"), (0.20, f"1 - {g('sf', 'same_composition_family_rate')}"), (0.15, "mis")],
    }
    against = {
        "hub": [f"{g('ad', 'chemical_system_count')} > 150", "ovc > 0", f"{g('sf', 'same_formula_family_rate')} < 0.6 AND {g('sf', 'same_prototype_family_rate')} < 0.6"],
        "bridge": ["spread <= 0.05", f"{g('ad', 'mean_element_overlap_fraction')} < 0.3"],
        "boundary": [f"{g('bo', 'stable_fraction')} < 0.5", f"{g('bo', 'same_spacegroup_rate')} > 0.5", "ctx < 0.3", "pen"],
        "outlier": [f"{g('sf', 'n_candidates')} >= 100", f"{g('ad', 'n_candidates')} >= 100", "sep > 0.8"],
    }
    third = {}
    for r, listed in parts.items():
        raw = f"({' + '.join(f'{w} * {_zero(v)}' for w, v in listed)}) / {sum(w for w, _ in listed)}"
        third[f"{r}_raw"] = f"CASE WHEN pen THEN greatest({raw} - 0.16, 0.0) ELSE {raw} END" if r == "boundary" else raw
        third[f"{r}_con"] = " + ".join(f"({x})::INT" for x in (*against[r], "mis > 0.25"))

    def quality(pools: tuple[str, ...]) -> str:
        there = " + ".join(f"({k}_n_candidates IS NOT NULL)::INT" for k in pools)
        full = " + ".join(f"coalesce({k}_n_candidates > 0, false)::INT" for k in pools)
        return f"CASE WHEN {there} = 0 THEN 0.0 ELSE {_zero(f'0.45 * ({full}) / greatest({there}, 1) + 0.35 * (1 - {_zero(f_mean(*[f_mi(k) for k in pools]))}) + 0.2')} END"

    f_mi = lambda k: f"mi_{k}"
    f_mean = lambda *v: f"coalesce({P._mean(*v)}, 0.0)"
    needs = {"hub": ("sf", "ne"), "bridge": ("ad", "sf", "ne"), "boundary": ("bo", "sf"), "outlier": ("sf", "ad", "ne", "wi")}
    fourth = {f"{r}_score": f"round({_zero(f'{r}_raw - least(0.25, 0.035 * {r}_con)')}, 6)" for r in parts} | {f"{r}_base": f"round({quality(needs[r])}, 6)" for r in parts} | {"qual": quality(tuple(SHORT.values()))}

    def confidence(r: str, gap: str) -> str:
        base, missing = f"{r}_base", _zero("mis")
        inner = _zero("0.35 * fspec + 0.45 * sspec + 0.2 * anchor")
        return f"round({_zero(f'0.3 * {_zero(base)} + 0.25 * {inner} + 0.15 * {r}_score + 0.15 * greatest(0.0, 1 - 0.1 * {r}_con) + 0.1 * {_zero(f'({gap}) / 0.25')} + 0.05 * (1 - {missing})')}, 6)"

    fifth = {f"{r}_first": confidence(r, "0.0") for r in parts} | {"gap": "abs(hub_score - boundary_score)"}
    ranked = lambda rs: "list_max([" + ", ".join(f"{{'s': {r}_score, 'k': {r}_first, 'o': {-i}, 'r': '{r}'}}" for i, r in enumerate(rs)) + "])"
    sixth = {"core": ranked(("hub", "boundary")), "top_role": f"{ranked(('hub', 'boundary', 'bridge', 'outlier'))}.r"}
    entries = most(" + ".join(g(k, "n_candidates") for k in SHORT.values()), "1.0")
    seventh = {
        "suff0": _zero(f"0.25 * anchor + 0.2 * sspec + 0.15 * sep + 0.15 * qual + 0.1 * {_zero('gap / 0.08')} + 0.1 * (1 - {_zero('mis')}) + 0.05 * (1 - {_zero(f'coalesce(several, 0) / {entries}')})"),
        "gen": "fspec < 0.25 OR sspec < 0.4 OR anchor < 0.4",
        "strong": "core.s >= 0.7 AND core.k >= 0.6",
    }
    eighth = {"suff": "CASE WHEN gen AND NOT strong THEN least(suff0, 0.54) ELSE suff0 END"}
    ninth = {"status": "CASE WHEN suff >= 0.55 THEN 'sufficient' WHEN strong THEN 'sufficient_with_caution' ELSE 'insufficient' END"} | {f"{r}_confidence": confidence(r, f"CASE WHEN top_role = '{r}' THEN gap ELSE 0.0 END") for r in parts}
    tenth = {}
    for r in parts:
        plain = f"CASE WHEN {r}_confidence < 0.45 THEN 'insufficient_evidence' WHEN {r}_score >= 0.7 THEN 'supported' WHEN {r}_score >= 0.45 THEN 'partial' ELSE 'not_supported' END"
        if r != "outlier":
            strong = f"{r}_score >= 0.7" if r in ("hub", "boundary") else "false"
            kept = f"{r}_score >= 0.7 AND {r}_confidence >= 0.6" if r in ("hub", "boundary") else "false"
            gated = f"CASE WHEN ({plain}) IN ('supported', 'partial') AND NOT ({strong}) THEN CASE WHEN fspec < 0.25 THEN 'not_supported_due_to_generic_context' WHEN sspec < 0.4 THEN 'not_supported_due_to_weak_structural_context' WHEN anchor < 0.4 THEN 'not_supported_due_to_weak_anchor' ELSE ({plain}) END ELSE ({plain}) END"
            plain = f"CASE WHEN status = 'insufficient' AND NOT ({kept}) THEN 'not_supported_due_to_insufficient_context' ELSE {gated} END"
        tenth[f"{r}_plausibility"] = plain
        if r in ("hub", "boundary"):
            bands = " ".join(f"WHEN {r}_score >= {v} THEN '{n}'" for v, n in STRENGTH_STEPS)
            tenth[f"{r}_band"] = f"CASE WHEN status = 'insufficient' AND {r}_score < 0.7 THEN 'insufficient_evidence' WHEN {r}_confidence < 0.45 THEN 'insufficient_evidence' WHEN {r}_score >= 0.85 AND {r}_confidence < 0.7 THEN 'strong' ELSE CASE {bands} ELSE 'very_weak' END END"
    good = "('moderate', 'strong', 'very_strong')"
    size_of = lambda k: g(k, "n_candidates")
    eleventh = {
        "primary_role": f"CASE WHEN hub_band IN {good} OR boundary_band IN {good} THEN CASE WHEN hub_score > boundary_score OR (hub_score = boundary_score AND hub_confidence >= boundary_confidence) THEN 'hub' ELSE 'boundary' END ELSE 'other' END",
        "context_ambiguity": f"round({_zero('1 - gap / 0.25')}, 6)",
        "pool_independence": f"round(1 - {_zero('coalesce(several / nullif(uniq, 0), 0.0)')}, 6)",
        "retrieval_completeness": f"round({P._mean(*[f'least({size_of(k)} / {n}, 1.0)' for k, n in (('sf', 500.0), ('ad', 500.0), ('bo', 500.0), ('ne', 100.0))])}, 6)",
    }
    twelfth = {"profile_confidence": f"round({_zero('0.3 * ' + _zero('round(suff, 6)') + ' + 0.2 * ' + _zero('retrieval_completeness') + ' + 0.15 * ' + _zero('pool_independence') + ' + 0.15 * (1 - ' + _zero('context_ambiguity') + ') + 0.2 * (' + _zero('hub_confidence') + ' + ' + _zero('boundary_confidence') + ') / 2')}, 6)"}
    s, c = "hub_score", "boundary_score"
    pattern = f"CASE WHEN status = 'insufficient' OR profile_confidence < 0.35 THEN 'reliability_limited_context' WHEN {s} >= 0.7 AND {c} >= 0.7 THEN 'well_supported_contrast_rich' WHEN {s} >= 0.7 AND {c} < 0.55 THEN 'well_supported_low_contrast' WHEN {s} < 0.55 AND {c} >= 0.7 THEN 'sparse_contrast_rich' WHEN {s} < 0.55 AND {c} < 0.55 THEN 'weakly_contextualised' ELSE 'mixed_context' END"
    ctes = [
        _wide(names),
        f"mr AS (SELECT query_id, avg(r) AS mi_all, {', '.join(f'''avg(r) FILTER (pool_name = '{p}') AS mi_{k}''' for p, k in SHORT.items())} FROM ({rates}) GROUP BY 1)",
        "io AS (SELECT query_id, count(*) AS uniq, sum((k > 1)::INT) AS several, count(*) FILTER (sfad) AS shared FROM (SELECT query_id, candidate_id, count(DISTINCT pool_name) AS k, bool_or(pool_name = 'same_family') AND bool_or(pool_name = 'adjacent_family') AS sfad FROM p GROUP BY 1, 2) GROUP BY 1)",
        "n0 AS (SELECT wide.*, mr.* EXCLUDE (query_id), io.* EXCLUDE (query_id), q_formula_family, q_prototype_family, q_structure_variant, q_spacegroup_number FROM wide LEFT JOIN mr USING (query_id) LEFT JOIN io USING (query_id) LEFT JOIN q USING (query_id))",
    ]
    levels = [first, second, third, fourth, fifth, sixth, seventh, eighth, ninth, tenth, eleventh, twelfth]
    for i, level in enumerate(levels):
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT *, {', '.join(f'({v}) AS {k}' for k, v in level.items())} FROM n{i})")
    out = ", ".join(f"{r}_score::DOUBLE AS {r}_score, {r}_con::INT AS {r}_contradictions, {r}_confidence::DOUBLE AS {r}_confidence, {r}_plausibility" for r in parts)
    return (
        ",\n".join(ctes),
        f"SELECT query_id, {out}, hub_band, boundary_band, round(suff, 6)::DOUBLE AS sufficiency, round(anchor, 6)::DOUBLE AS anchor, status, gen AS generic_overclaim_risk, primary_role, (CASE primary_role WHEN 'hub' THEN hub_score WHEN 'boundary' THEN boundary_score END)::DOUBLE AS primary_score, gap < 0.08 AS ambiguous, context_ambiguity::DOUBLE AS context_ambiguity, pool_independence::DOUBLE AS pool_independence, retrieval_completeness::DOUBLE AS retrieval_completeness, profile_confidence::DOUBLE AS profile_confidence, {pattern} AS contextual_pattern FROM n{len(levels)}",
    )


def _weighted(parts: list[tuple[str, float]]) -> str:
    total = " + ".join(f"coalesce(({v}) * {w}, 0)" for v, w in parts)
    weight = " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0 ELSE {w} END" for v, w in parts)
    return f"({total}) / nullif({weight}, 0)"


def combined_sql(identity: str, distribution: str, then: str | None = None) -> str:
    """SQL of the comparison of all pairs, or of what ``then`` selects from the pairs
    (``c4``), their long form with gaps filled (``l``: id, other, s) and the five
    nearest others (``k``: with neighbour_rank); ``identity`` and ``distribution`` are CTEs that
    end in ``idn`` and ``dsn`` (a, b and the similarity, not rounded)."""
    ctes, rows = _roles((*H.MATCH_RATES, *H.CONTEXT_RATES))
    like = lambda x, y: f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN NULL WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 ELSE 1 - abs({_clip(x)} - {_clip(y)}) END"
    count = lambda x, y: f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN NULL WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 WHEN greatest({x}, {y}) > 0 THEN least({x}, {y}) / greatest({x}, {y}) ELSE 1.0 END"
    pools = [(SHORT[p], w) for p, w in H.POOL_WEIGHTS.items()]
    context = {k: P._mean(*[like(f"wa.{k}_{m}", f"wb.{k}_{m}") for m in (*H.MATCH_RATES, *H.CONTEXT_RATES)], count(f"wa.{k}_n_candidates", f"wb.{k}_n_candidates")) for k, _ in pools}
    label = lambda n: f"CASE WHEN nullif(trim(qa.{n}::VARCHAR), '') IS NULL AND nullif(trim(qb.{n}::VARCHAR), '') IS NULL THEN NULL WHEN lower(trim(qa.{n}::VARCHAR)) = lower(trim(qb.{n}::VARCHAR)) THEN 1.0 ELSE 0.0 END"
    shared = "len(list_intersect(qa.q_elements, qb.q_elements)) / nullif(len(list_distinct(qa.q_elements || qb.q_elements)), 0)"
    chemistry = _weighted([(shared, 0.4), *[(label(n), w) for n, w in (("q_composition_family", 0.1), ("q_formula_family", 0.2), ("q_prototype_family", 0.1), ("q_structure_variant", 0.1), ("q_crystal_system_code", 0.1))]])
    measures = ("hub_score", "boundary_score", "sufficiency", "profile_confidence")
    gap = " + ".join(f"(ra.{m} - rb.{m}) ** 2" for m in measures)
    parts = {"profile": ("profile_similarity", H.PROFILE), "identity": ("identity_similarity", (1 - H.PROFILE) * H.IDENTITY), "distribution": ("distribution_similarity", (1 - H.PROFILE) * H.DISTRIBUTION), "context": ("context_feature_similarity", (1 - H.PROFILE) * H.CONTEXT)}
    all_parts = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts.values())
    lead = "list_max([" + ", ".join(f"{{'v': round({k}_share, 9), 'o': {-i}, 'k': '{k}'}}" for i, k in enumerate(parts)) + "]).k"
    rounded = ["profile_similarity", "chemistry_similarity", "pair_reliability", "all_reference_jaccard", "identity_similarity", "distribution_similarity", "context_feature_similarity", "neighbourhood_similarity", "combined_similarity", "discordance", *[f"{k}_share" for k in parts]]
    shown = f"SELECT a, b, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in rounded)}, discordance_type, leading_part, printf('%s and %s: combined similarity %.2f, led by %s; %s.', a, b, combined_similarity::DOUBLE, leading_part, replace(discordance_type, '_', ' ')) AS explanation FROM c4"
    return f"""{ctes},
rs AS MATERIALIZED ({rows}),
{identity},
{distribution},
cx AS MATERIALIZED (SELECT wa.query_id AS a, wb.query_id AS b, {', '.join(f'{v} AS c_{k}' for k, v in context.items())} FROM wide wa JOIN wide wb ON wa.query_id < wb.query_id),
cb AS MATERIALIZED (SELECT ra.query_id AS a, rb.query_id AS b, greatest(0.0, 1 - sqrt(({gap}) / {len(measures)})) AS profile_similarity, {chemistry} AS chemistry_similarity, sqrt(ra.profile_confidence * rb.profile_confidence) AS pair_reliability
  FROM rs ra JOIN rs rb ON ra.query_id < rb.query_id JOIN q qa ON qa.query_id = ra.query_id JOIN q qb ON qb.query_id = rb.query_id),
c1 AS (SELECT cb.*, all_reference_jaccard, identity_similarity, distribution_similarity, {_weighted([(f'c_{k}', w) for k, w in pools])} AS context_feature_similarity FROM cb LEFT JOIN idn USING (a, b) LEFT JOIN dsn USING (a, b) LEFT JOIN cx USING (a, b)),
c2 AS (SELECT *, {_weighted([('identity_similarity', H.IDENTITY), ('distribution_similarity', H.DISTRIBUTION), ('context_feature_similarity', H.CONTEXT)])} AS neighbourhood_similarity FROM c1),
c3 AS (SELECT *, {_weighted([('profile_similarity', H.PROFILE), ('neighbourhood_similarity', 1 - H.PROFILE)])} AS combined_similarity, abs(profile_similarity - neighbourhood_similarity) AS discordance,
  CASE WHEN profile_similarity IS NULL OR neighbourhood_similarity IS NULL THEN 'insufficient_components' WHEN profile_similarity >= 0.9 AND neighbourhood_similarity <= 0.5 THEN 'similar_profile_different_reference_neighbourhood' WHEN profile_similarity <= 0.65 AND neighbourhood_similarity >= 0.85 THEN 'different_profile_similar_reference_neighbourhood'
   WHEN profile_similarity > neighbourhood_similarity THEN 'profile_similarity_exceeds_neighbourhood_similarity' WHEN neighbourhood_similarity > profile_similarity THEN 'neighbourhood_similarity_exceeds_profile_similarity' ELSE 'aligned' END AS discordance_type, {', '.join(f'coalesce({c} * {w}, 0) / nullif({all_parts}, 0) AS {k}_share' for k, (c, w) in parts.items())} FROM c2),
c4 AS MATERIALIZED (SELECT *, {lead} AS leading_part FROM c3),
l0 AS (SELECT a AS id, b AS other, combined_similarity::DOUBLE AS s FROM c4 UNION ALL SELECT b, a, combined_similarity::DOUBLE FROM c4),
l AS MATERIALIZED (SELECT id, other, least(greatest(coalesce(s, (SELECT median(s) FROM (SELECT s FROM l0 UNION ALL SELECT 1.0 FROM (SELECT DISTINCT id FROM l0)) WHERE s IS NOT NULL)), 0.0), 1.0) AS s FROM l0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other)::INT AS neighbour_rank FROM l QUALIFY neighbour_rank <= 5)
{then or shown}"""
