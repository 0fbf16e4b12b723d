"""Queries over the stored pairs, cases and profiles, whole tables each, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions import scores as Z
from vicinage.functions import similarity as X
from vicinage.operators import cohort as H
from vicinage.operators import plausibility as A
from vicinage.operators import pool_metrics as M
from vicinage.operators import reachability as Y
from vicinage.operators import roles as Q
from vicinage.operators import universe as U
from vicinage.plans import cohort_queries as K
from vicinage.plans import concept_sql
from vicinage.plans import retrieval_queries as P
from vicinage.plans.views import session_view
from vicinage.session import cut_lineage
from vicinage.sources import read_table
from vicinage.streaming.queries import event_rates

NEIGHBOURS = "nearest_contextual_neighbours_1c2"
CASES = "structural_context_batch_summary"


def _unit(name: str) -> Column:
    """A stored value within 0..1; anything else is null."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & (c >= 0) & (c <= 1), c)


@session_view
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered stored pairs with the greatest of each similarity, as the comparison of a cohort has them."""
    rows = read_table(spark, sf_dir, NEIGHBOURS).filter("candidate_id != neighbour_id")
    names = {"combined_similarity": "combined_context_similarity", "profile_similarity": "profile_similarity", "neighbourhood_similarity": "reference_neighbourhood_similarity"}
    grouped = rows.groupBy(F.least("candidate_id", "neighbour_id").alias("a"), F.greatest("candidate_id", "neighbour_id").alias("b")).agg(*[F.max(_unit(v)).alias(k) for k, v in names.items()])
    return cut_lineage(grouped)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.both_ways(_stored(spark, sf_dir).filter("combined_similarity IS NOT NULL"), "combined_similarity")


def q_stored_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar stored others of every material."""
    return P._rounded(H.nearest(_long(spark, sf_dir), 5))


def q_stored_distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every material lies from its five nearest stored others."""
    return P._rounded(H.distinctiveness(_long(spark, sf_dir), 5), 10)


def q_stored_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of materials joined by stored pairs that are alike in every respect."""
    return H.redundancy(_stored(spark, sf_dir), combined=0.85, component=0.6)


@session_view
def _family_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the universe as clusters, numbered by name."""
    base = P.universe(spark, sf_dir).filter("composition_family IS NOT NULL")
    names = sorted(r[0] for r in base.select("composition_family").distinct().limit(100).collect())
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i + 1)]), F.col("composition_family"))
    return cut_lineage(base.select(F.col("jid").alias("id"), number.alias("cluster_id")))


def q_stored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families as clusters of stored pairs: size, mean similarity within and the medoid."""
    labels = _family_labels(spark, sf_dir)
    return P._rounded(H.cluster_summary(_long(spark, sf_dir), labels, labels.select("id", F.lit(1.0).alias("reliability"))))


def q_stored_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every material's mean similarity to its own family and to the best other one."""
    long = _long(spark, sf_dir)
    labels = _family_labels(spark, sf_dir)
    return P._rounded(H.between_clusters(long, labels.join(long.select("id").distinct(), "id", "left_semi")), 12)


def q_score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small scores, each applied to the measures of every case."""
    names = {"x": "local_context_support", "y": "structural_regime_contrast", "z": "neighbourhood_coherence", "d": "structural_context_diversity", "e": "evidence_sufficiency_score", "o": "pool_overlap_rate", "m": "context_ambiguity", "p": "profile_confidence"}
    rows = read_table(spark, sf_dir, CASES)
    rows = rows.select("case_id", F.col("batch_index").cast("double").alias("n"), F.col("evidence_sufficiency_status").alias("status"), F.col("profile_prototype_family").alias("prototype"), F.col("profile_structure_variant").alias("variant"), *[_unit(v).alias(k) for k, v in names.items()]).distinct()
    x, y, z, d, e, o, m, p, status = (F.col(c) for c in (*names, "status"))
    rows = rows.withColumn("specificity", Z.label_specificity(None, F.coalesce("prototype", F.lit("")), F.coalesce("variant", F.lit(""))))
    rows = rows.withColumn("plausible", Z.plausibility(x, p))
    out = {
        "mean_available": Z.mean_available(x, y, z),
        "mean_clipped": Z.mean_clipped(x, y, z),
        "product_available": Z.product_available(x, y),
        "weighted_mean": Z.weighted_mean([(x, 0.5), (y, 0.3), (z, 0.2)]),
        "weighted_score": Z.weighted_score({"a": x, "b": y, "c": z}, {"a": 0.5, "b": 0.25, "c": 0.15, "absent": 0.1}),
        "balance_by_ratio": Z.balance_by_ratio(x, y),
        "balance_by_gap": Z.balance_by_gap(x, y),
        "closeness": Z.closeness(x, y),
        "entropy_with_zeros": Z.entropy_of([x, y, z, d], zeros_count=True),
        "entropy": Z.entropy_of([x, y, z, d], zeros_count=False),
        "norm_count": Z.norm_count(F.col("n"), 50),
        "context_band": Z.band(x, Z.CONTEXT_STEPS, "very_low"),
        "strength": Z.strength_band(x, p, status),
        "plausible": F.col("plausible"),
        "role_confidence": Z.role_confidence(e, x, F.lit(2), F.col("specificity"), F.coalesce(y, F.lit(0.0)), F.coalesce(z, F.lit(0.0)), m, o),
        "specificity": F.col("specificity"),
        "gated_bridge": Z.context_gate("bridge", F.col("plausible"), x, F.col("specificity"), y, z),
        "gated_hub": Z.context_gate("hub", F.col("plausible"), x, F.col("specificity"), y, z),
        "confidence": Z.profile_confidence(e, z, F.lit(1.0) - o, m, x, y),
        "pattern": Z.contextual_pattern(x, y, p, status),
        "numeric_similarity": X.numeric_similarity(x, y),
        "count_similarity": X.count_similarity(F.col("n"), F.col("n") / 2 + 1),
    }
    return P._rounded(rows.select("case_id", *[v.alias(k) for k, v in out.items()]).distinct(), 12)


CORE = ("local_context_support", "structural_regime_contrast")
RELIABLE = ("profile_confidence", "neighbourhood_coherence", "evidence_sufficiency_score")


def q_cohort_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cases may be compared, and how reliable each is; one row per case."""
    cases = read_table(spark, sf_dir, CASES)
    one = U.keep_first(cases, ["case_id"], [F.col(c).asc_nulls_first() for c in ("finished_at", "loaded_at", "batch_index")])
    checked = H.prepare_cohort(one, "case_id", CORE, confidence="profile_confidence", completeness="evidence_sufficiency_score")
    known = read_table(spark, sf_dir, NEIGHBOURS).select(F.col("candidate_id").alias("id")).distinct()
    return P._rounded(H.eligible(checked, known, RELIABLE))


def q_pair_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the one of every stored pair can be reached from the other."""
    return P._rounded(_reached(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ";")))


@session_view
def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P._neighbour_pairs(spark, sf_dir).select(F.col("candidate_id").alias("jid_a"), F.col("neighbour_id").alias("jid_b")).filter("jid_a != jid_b")
    return cut_lineage(Y.reachability(pairs, P.with_controls(spark, sf_dir)))


def q_pair_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored pairs are worth a comparison, and what the others lack."""
    # magnitudes are compared with limits, so they are rounded as in SQL
    screened = U.pair_screen(P._deltas(spark, sf_dir)).withColumns({m: F.round(m, 9) for m in ("mean_delta", "max_delta", "topk_delta")})
    return P._rounded(Y.precheck(_reached(spark, sf_dir), screened).withColumn("reasons", F.array_join("reasons", ";")))


def q_pair_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How profile and neighbourhood agree in every stored pair, in words."""
    return P._rounded(H.profile_reading(_stored(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.material_queries(spark, sf_dir).select(F.col("query_id").alias("jid"))


def q_physical_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of stability of the materials whose id number is divisible by 20, by point lookup."""
    return U.physical_properties(U.resolve(P.universe(spark, sf_dir), _asked(spark, sf_dir)))


def q_external_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all external materials."""
    base = P.universe(spark, sf_dir)
    return U.physical_properties(U.resolve_external(base, base.select("jid"), strict=False))


def q_profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat profile rows of the materials whose id number is divisible by 20."""
    rows = U.profile_rows(U.resolve(P.universe(spark, sf_dir), _asked(spark, sf_dir)))
    return P._rounded(rows.withColumn("elements", F.array_join("elements", ";")))


def q_query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control materials as queries, with what their pools are asked for."""
    return P.controls(spark, sf_dir).withColumn("q_elements", F.array_join("q_elements", ";"))


def q_standard_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all materials in deviations from the mean, one row per feature."""
    base = P.universe(spark, sf_dir)
    vectors = U.standard_vector(base, U.feature_stats(base, P.FEATURES), P.FEATURES)
    return P._rounded(vectors.select("jid", F.posexplode("vector").alias("place", "value")))


def q_reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every neighbour record of the fingerprints of the control materials."""
    pools = H.fingerprint(P.pools(spark, sf_dir)).select("query_id", F.explode("pools").alias("pool_name", "pool"))
    return P._rounded(pools.select("query_id", "pool_name", F.explode("pool.neighbours").alias("n")).select("query_id", "pool_name", "n.*"))


def q_rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank weights of the references of the control materials."""
    return P._rounded(H.rank_table(P.pools(spark, sf_dir)))


def q_pair_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the comparison of two control materials can be explained: coverage, confidence, difference in diversity."""
    pools = P.pools(spark, sf_dir)
    coverage = M.coverage(pools, list(H.COVERAGE_WEIGHTS)).filter("pool_name IS NULL")
    counts = M.value_counts(pools.withColumn("pool_name", F.lit("all")), H.ENTROPY_FIELDS)
    pairs = H._all_pairs(pools.select("query_id").distinct(), 2_500)
    return P._rounded(H.explainability(pairs, coverage, M.entropies(counts)))


#: overlapping strata of a run: name, condition and size
STRATA = (("all", "true", 300), ("oxides", "composition_family = 'oxide'", 150), ("external", "dataset_kind = 'external'", 40), ("stable", "energy_above_hull <= 0.05", 200))
SAMPLE_SEED = 87


def q_sample_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of every stratum of the universe; a sampling operator, so the sizes are its feature."""
    drawn = U.sample_strata(P.universe(spark, sf_dir), [(name, F.expr(where), n) for name, where, n in STRATA], seed=SAMPLE_SEED)
    return drawn.select("jid", "composition_family", "dataset_kind")


def q_event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of events by hour and kind; the same plan serves streams."""
    return P._rounded(event_rates(read_table(spark, sf_dir, "events")))


def q_plausible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of stored pairs by plausibility."""
    pairs = A.annotate_pairs(P._neighbour_pairs(spark, sf_dir), P._annotated(spark, sf_dir), a="candidate_id", b="neighbour_id")
    return pairs.groupBy("pair_label").agg(F.count(F.lit(1)).alias("n"))


# stored pairs of materials and controls: the queries of the same names without "stored_" have SQL without the controls
def q_stored_element_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.q_element_jaccard(spark, sf_dir)


def q_stored_pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.q_pair_deltas(spark, sf_dir)


def q_stored_group_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.q_group_deltas(spark, sf_dir)


def q_stored_top_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.q_top_deltas(spark, sf_dir)


def q_stored_pair_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.q_pair_screen(spark, sf_dir)


def queries() -> dict:
    return {n.removeprefix("q_"): f for n, f in globals().items() if n.startswith("q_")}


# ---------------------------------------------------------------- SQL


def _u(c: str) -> str:
    return f"CASE WHEN {c} BETWEEN 0 AND 1 AND NOT isnan({c}) THEN {c}::DOUBLE END"


def _stored_sql() -> str:
    return f"""s AS MATERIALIZED (SELECT least(candidate_id, neighbour_id) AS a, greatest(candidate_id, neighbour_id) AS b, max({_u('combined_context_similarity')}) AS c, max({_u('profile_similarity')}) AS p, max({_u('reference_neighbourhood_similarity')}) AS h
  FROM {NEIGHBOURS} WHERE candidate_id != neighbour_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a AS id, b AS other, c AS similarity FROM s WHERE c IS NOT NULL UNION ALL SELECT b, a, c FROM s WHERE c IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other)::INT AS neighbour_rank FROM l QUALIFY neighbour_rank <= 5)"""


def _with_controls_sql() -> str:
    columns = "jid, formula, elements, chemical_system, composition_family, spacegroup_number, crystal_system_code, band_gap, formation_energy, density_feature, n_elements, metal_count, nonmetal_count"
    return f"WITH {P.universe_ctes()},\n cc AS (SELECT * FROM {P.prepared_sql('control_materials', has=('formula',))} QUALIFY row_number() OVER (PARTITION BY jid ORDER BY formula) = 1),\n uc AS MATERIALIZED (SELECT {columns} FROM u UNION ALL SELECT {columns} FROM cc WHERE jid NOT IN (SELECT jid FROM u))"


def _deltas_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN stddev_pop({f}::DOUBLE) > 1e-12 THEN stddev_pop({f}::DOUBLE) ELSE 1.0 END AS std FROM u" for f in P.FEATURES)
    long = " UNION ALL ".join(f"SELECT jid, '{f}' AS feature, {f}::DOUBLE AS value FROM uc WHERE {f} IS NOT NULL" for f in P.FEATURES)
    return f"""fs AS MATERIALIZED ({parts}), fl AS MATERIALIZED ({long}),
np AS MATERIALIZED (SELECT DISTINCT candidate_id AS jid_a, neighbour_id AS jid_b FROM {NEIGHBOURS} WHERE candidate_id != neighbour_id),
dl AS MATERIALIZED (SELECT jid_a, jid_b, a.feature, (b.value - a.value) / fs.std AS delta FROM np JOIN fl a ON a.jid = jid_a JOIN fl b ON b.jid = jid_b AND b.feature = a.feature JOIN fs ON fs.feature = a.feature)"""


def _reach_sql() -> str:
    jumps = "('" + "', '".join(Y.BONDING_JUMPS) + "')"
    return f"""{_with_controls_sql()},
{_deltas_sql()},
ft AS (SELECT jid, e, sum(coalesce(try_cast(nullif(x, '') AS DOUBLE), 1)) AS n FROM (SELECT jid, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)) AS e, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 2)) AS x FROM uc) GROUP BY 1, 2 HAVING n > 0),
fd AS (SELECT jid, list(e ORDER BY e) AS es, list(n ORDER BY e) AS ns, bool_and(abs(n - round(n)) < 1e-6) AS whole FROM ft GROUP BY 1),
fk AS MATERIALIZED (SELECT uc.jid, es, composition_family AS f, spacegroup_number AS sg, crystal_system_code AS cs, CASE WHEN whole THEN list_transform(ns, lambda v: v::BIGINT // list_reduce(list_transform(ns, lambda w: w::BIGINT), lambda i, j: gcd(i, j))) END AS r FROM uc LEFT JOIN fd USING (jid)),
r0 AS (SELECT jid_a, jid_b, a.es IS NOT NULL AND b.es IS NOT NULL AS ok, CASE WHEN a.es IS NOT NULL AND b.es IS NOT NULL THEN len(list_intersect(a.es, b.es)) / len(list_distinct(a.es || b.es)) ELSE 0.0 END AS j, coalesce(a.es = b.es AND a.r = b.r, false) AS sf, coalesce(a.es = b.es, false) AS ss,
   coalesce(a.f = b.f AND a.es IS NOT NULL AND b.es IS NOT NULL, false) AS fam, coalesce(a.f = 'elemental', false) AS ea, coalesce(b.f = 'elemental', false) AS eb, coalesce(a.f = 'intermetallic' AND b.f IN {jumps}, false) OR coalesce(b.f = 'intermetallic' AND a.f IN {jumps}, false) AS jump,
   CASE WHEN a.es IS NULL OR b.es IS NULL THEN 0 ELSE CASE WHEN abs(a.sg - b.sg) <= 20 THEN 0.35 WHEN abs(a.sg - b.sg) <= 80 THEN 0.15 ELSE 0 END + CASE WHEN a.cs = b.cs THEN 0.2 ELSE 0 END END::DOUBLE AS st FROM np JOIN fk a ON a.jid = jid_a JOIN fk b ON b.jid = jid_b),
r1 AS (SELECT *, CASE WHEN sf THEN 'same_reduced_formula' WHEN ss THEN 'same_chemical_system' WHEN j >= 0.5 THEN 'substantial_element_overlap' WHEN j > 0 THEN 'partial_element_overlap' ELSE 'no_element_overlap' END AS rel,
   CASE WHEN NOT ok THEN 0.0 ELSE least(1.0, CASE WHEN sf THEN 1.0 WHEN ss THEN 0.75 WHEN j >= 0.5 THEN 0.45 WHEN j > 0 THEN 0.2 ELSE 0 END + CASE WHEN fam THEN 0.2 ELSE 0 END) END::DOUBLE AS ch FROM r0),
rr AS MATERIALIZED (SELECT jid_a, jid_b, round(j, 6) AS element_jaccard, sf AS same_reduced_formula, ss AS same_chemical_system, fam AS same_family, round(ch, 6) AS chemical_score, round(st, 6) AS structural_score, round(CASE WHEN ok THEN least(1, 0.65 * ch + 0.35 * st) ELSE 0 END, 6)::DOUBLE AS reachability_score,
   NOT ok OR (j = 0 AND NOT fam) OR (ea != eb) OR (jump AND j = 0) AS hard_reject,
   array_to_string(list_filter([CASE WHEN NOT ok THEN 'composition_parse_failure' END, CASE WHEN ok THEN rel END, CASE WHEN ok THEN CASE WHEN fam THEN 'same_composition_family' ELSE 'different_composition_family' END END, CASE WHEN ok AND ea AND NOT eb THEN 'elemental_to_compound_jump' END,
     CASE WHEN ok AND eb AND NOT ea THEN 'compound_to_elemental_jump' END, CASE WHEN ok AND jump THEN 'cross_bonding_regime_jump' END], lambda v: v IS NOT NULL), ';') AS reasons FROM r1)"""


def _score_sql() -> str:
    names = {"x": "local_context_support", "y": "structural_regime_contrast", "z": "neighbourhood_coherence", "d": "structural_context_diversity", "e": "evidence_sufficiency_score", "o": "pool_overlap_rate", "m": "context_ambiguity", "p": "profile_confidence"}
    zero = lambda c: f"coalesce({c}, 0.0)"
    clip = lambda c: f"least(1.0, greatest(0.0, {c}))"
    generic = "('" + "', '".join(Z.GENERIC_LABELS) + "')"
    label = lambda c, w: f"CASE WHEN lower(trim(coalesce({c}, ''))) NOT IN {generic} AND NOT starts_with(lower(trim(coalesce({c}, ''))), 'unknown') THEN {w} ELSE 0.0 END"
    listed = "[x, y, z, d]"

    def entropy(keep: str, empty: str) -> str:
        kept = f"list_filter({listed}, lambda v: v IS NOT NULL AND v {keep} 0)"
        total = f"list_sum({kept})"
        bits = f"-list_sum(list_transform(list_filter({kept}, lambda v: v > 0), lambda v: v / {total} * log2(v / {total})))"
        return f"CASE WHEN len({kept}) = 0 THEN {empty} WHEN len({kept}) = 1 OR {total} <= 0 THEN 0.0 ELSE {bits} / log2(len({kept})) END"

    def gate(strong: str) -> str:
        return f"CASE WHEN plausible IN ('supported', 'partial') AND NOT ({strong}) THEN CASE WHEN specificity < 0.25 THEN 'not_supported_due_to_generic_context' WHEN y < 0.4 THEN 'not_supported_due_to_weak_structural_context' WHEN z < 0.4 THEN 'not_supported_due_to_weak_anchor' ELSE plausible END ELSE plausible END"

    steps = lambda t, low: "CASE " + " ".join(f"WHEN x >= {v} THEN '{n}'" for v, n in t) + f" ELSE '{low}' END"
    numbers = {
        "mean_available": "list_avg(list_filter([x, y, z], lambda v: v IS NOT NULL))",
        "mean_clipped": f"({zero('x')} + {zero('y')} + {zero('z')}) / 3",
        "product_available": "CASE WHEN coalesce(x, y) IS NOT NULL THEN coalesce(x, 1.0) * coalesce(y, 1.0) END",
        "weighted_mean": "(coalesce(x * 0.5, 0) + coalesce(y * 0.3, 0) + coalesce(z * 0.2, 0)) / nullif(CASE WHEN x IS NULL THEN 0 ELSE 0.5 END + CASE WHEN y IS NULL THEN 0 ELSE 0.3 END + CASE WHEN z IS NULL THEN 0 ELSE 0.2 END, 0)",
        "weighted_score": f"{zero('x')} * 0.5 + {zero('y')} * 0.25 + {zero('z')} * 0.15",
        "balance_by_ratio": f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN greatest(x, y) <= 0 THEN 0.0 ELSE {clip('(x + y) / 2 * least(x, y) / greatest(x, y)')} END",
        "balance_by_gap": f"least({zero('x')}, {zero('y')}) * (1 - abs({zero('x')} - {zero('y')}))",
        "closeness": f"CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {clip('1 - abs(x - y) / 0.35')} END",
        "entropy_with_zeros": entropy(">=", "NULL"),
        "entropy": entropy(">", "0.0"),
        "norm_count": clip("coalesce(n / 50, 0)"),
        "role_confidence": clip(f"0.3 * {zero('e')} + 0.25 * {clip('0.35 * specificity + 0.45 * ' + zero('y') + ' + 0.2 * ' + zero('z'))} + 0.15 * {zero('x')} + 0.15 * 0.8 + 0.1 * {clip(zero('m') + ' / 0.25')} + 0.05 * (1 - {zero('o')})"),
        "specificity": "specificity",
        "confidence": clip(f"0.3 * {zero('e')} + 0.2 * {zero('z')} + 0.15 * coalesce(1 - o, 0) + 0.15 * (1 - {zero('m')}) + 0.2 * ({zero('x')} + {zero('y')}) / 2"),
        "numeric_similarity": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 - abs(x - y) WHEN coalesce(x, y) IS NOT NULL THEN 0.0 END",
        "count_similarity": "CASE WHEN n IS NOT NULL THEN CASE WHEN greatest(n, n / 2 + 1) <= 0 THEN 1.0 ELSE least(n, n / 2 + 1) / greatest(n, n / 2 + 1) END END",
    }
    texts = {
        "context_band": steps(Z.CONTEXT_STEPS, "very_low"),
        "strength": f"CASE WHEN status = 'insufficient' AND x < 0.7 THEN 'insufficient_evidence' WHEN p < 0.45 THEN 'insufficient_evidence' WHEN x >= 0.85 AND p < 0.7 THEN 'strong' ELSE {steps(Z.STRENGTH_STEPS, 'very_weak')} END",
        "plausible": "plausible",
        "gated_bridge": gate("false"),
        "gated_hub": gate("coalesce(x >= 0.7, false)"),
        "pattern": f"CASE WHEN lower(status) = 'insufficient' OR {zero('p')} < 0.35 THEN 'reliability_limited_context' WHEN {zero('x')} >= 0.7 AND {zero('y')} >= 0.7 THEN 'well_supported_contrast_rich' WHEN {zero('x')} >= 0.7 AND {zero('y')} < 0.55 THEN 'well_supported_low_contrast' "
        f"WHEN {zero('x')} < 0.55 AND {zero('y')} >= 0.7 THEN 'sparse_contrast_rich' WHEN {zero('x')} < 0.55 AND {zero('y')} < 0.55 THEN 'weakly_contextualised' ELSE 'mixed_context' END",
    }
    return f"""WITH r AS (SELECT DISTINCT case_id, batch_index::DOUBLE AS n, evidence_sufficiency_status AS status, profile_prototype_family AS prototype, profile_structure_variant AS variant, {', '.join(f'{_u(v)} AS {k}' for k, v in names.items())} FROM {CASES}),
s AS (SELECT *, (least({label('prototype', 0.45)} + {label('variant', 0.2)}, 1.0))::DOUBLE AS specificity, CASE WHEN p < 0.45 THEN 'insufficient_evidence' WHEN x >= 0.7 THEN 'supported' WHEN x >= 0.45 THEN 'partial' ELSE 'not_supported' END AS plausible FROM r)
SELECT DISTINCT case_id, {', '.join(f'round(({v})::DOUBLE, 12) AS {k}' for k, v in numbers.items())}, {', '.join(f'{v} AS {k}' for k, v in texts.items())} FROM s"""


def oracle_sql() -> dict[str, str]:
    uni, stored = f"WITH {P.universe_ctes()}", _stored_sql()
    asked = "try_cast(regexp_extract(jid, '^JVASP-([0-9]+)$', 1) AS BIGINT) % 20 = 0"
    labels = "lb AS MATERIALIZED (SELECT jid AS id, dense_rank() OVER (ORDER BY composition_family)::INT AS cluster_id FROM u WHERE composition_family IS NOT NULL)"
    out = {
        "stored_knn": f"WITH {stored} SELECT id, other, round(similarity, 6) AS similarity, neighbour_rank FROM k",
        "stored_distinctiveness": f"WITH {stored}, d AS (SELECT id, min(1 - similarity) AS nearest_distance, round(avg(1 - similarity), 9) AS mean_distance FROM k GROUP BY 1) SELECT id, round(nearest_distance, 10) AS nearest_distance, round(mean_distance, 10) AS mean_distance, "
        "round((rank() OVER (ORDER BY mean_distance) - 1 + (count(*) OVER (PARTITION BY mean_distance) + 1) / 2) / count(*) OVER (), 10) AS percentile_rank FROM d",
        "stored_redundancy": f"WITH RECURSIVE {stored}, e AS MATERIALIZED (SELECT a AS u, b AS v FROM s WHERE c >= 0.85 AND p >= 0.6 AND h >= 0.6 UNION SELECT b, a FROM s WHERE c >= 0.85 AND p >= 0.6 AND h >= 0.6), r AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), "
        "g AS (SELECT u AS id, min(v) AS root FROM r GROUP BY 1), z AS (SELECT root, count(*) AS group_size, row_number() OVER (ORDER BY count(*) DESC, root)::INT AS group_id FROM g GROUP BY 1) SELECT id, group_id, group_size FROM g JOIN z USING (root)",
        "stored_clusters": f"{uni}, {stored}, {labels}, sz AS (SELECT cluster_id, count(*) AS cluster_size FROM lb GROUP BY 1), i AS (SELECT l.*, x.cluster_id FROM l JOIN lb x ON x.id = l.id JOIN lb y ON y.id = l.other AND y.cluster_id = x.cluster_id), q AS (SELECT id, sum(1 - similarity) AS t FROM i GROUP BY 1), "
        "md AS (SELECT cluster_id, id FROM lb LEFT JOIN q USING (id) JOIN sz USING (cluster_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(coalesce(t, 0) / cluster_size, 9), id) = 1) "
        "SELECT cluster_id, cluster_size, md.id AS representative, round(coalesce(w, 1.0), 6) AS mean_similarity FROM sz JOIN md USING (cluster_id) LEFT JOIN (SELECT cluster_id, avg(similarity) AS w FROM i GROUP BY 1) USING (cluster_id)",
        "stored_borders": f"{uni}, {stored}, {labels}, i AS (SELECT l.id, x.cluster_id AS own, y.cluster_id AS theirs, avg(similarity) AS mean FROM l JOIN lb x ON x.id = l.id JOIN lb y ON y.id = l.other GROUP BY 1, 2, 3), "
        "b AS (SELECT id, theirs, round(mean, 12) AS mean FROM i WHERE own != theirs QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(mean, 12) DESC, theirs) = 1) "
        "SELECT lb.id, cluster_id, round(coalesce(i.mean, 1.0), 12) AS own_similarity, round(coalesce(b.mean, 0.0), 12) AS other_similarity, coalesce(b.theirs, 0) AS other_cluster, coalesce(i.mean, 1.0) - coalesce(b.mean, 0.0) <= 0.1 AS near_border FROM lb SEMI JOIN l ON l.id = lb.id LEFT JOIN i ON i.id = lb.id AND own = theirs LEFT JOIN b ON b.id = lb.id",
        "score_parts": _score_sql(),
        "cohort_eligibility": f"WITH o AS (SELECT * FROM {CASES} WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY finished_at NULLS FIRST, loaded_at NULLS FIRST, batch_index NULLS FIRST) = 1), n AS (SELECT DISTINCT candidate_id FROM {NEIGHBOURS}), "
        f"c AS (SELECT trim(case_id) AS id, {' + '.join(f'({x} IS NULL OR isnan({x}))::INT' for x in CORE)} AS missing_core, coalesce(profile_confidence < 0.5, false) AS low_confidence, coalesce(evidence_sufficiency_score < 0.5, false) AS low_completeness, n.candidate_id IS NOT NULL AS has_neighbours, "
        f"coalesce(list_avg(list_filter([{', '.join(f'CASE WHEN NOT isnan({x}) THEN least(greatest({x}, 0.0), 1.0) END' for x in RELIABLE)}], lambda v: v IS NOT NULL)), 0.0) AS reliability FROM o LEFT JOIN n ON candidate_id = trim(case_id)) "
        "SELECT id, missing_core, low_confidence, low_completeness, has_neighbours, round(reliability, 6) AS reliability, has_neighbours AND missing_core = 0 AND NOT low_confidence AND NOT low_completeness AS eligible FROM c",
        "pair_reachability": f"{_reach_sql()} SELECT * FROM rr",
        "pair_precheck": f"{_reach_sql()}, sc AS (SELECT jid_a, jid_b, count(*) AS n, round(avg(abs(delta)), 9) AS mean, round(max(abs(delta)), 9) AS most, round(list_avg(list_sort(list(abs(delta)), 'DESC')[1:5]), 9) AS topk FROM dl GROUP BY 1, 2), "
        "f AS (SELECT rr.jid_a, rr.jid_b, reachability_score, hard_reject, list_filter([CASE WHEN coalesce(n, 0) < 5 THEN 'too_few_comparable_features' END, CASE WHEN coalesce(mean, 0) < 0.15 THEN 'low_mean_standardized_delta' END, CASE WHEN coalesce(topk, 0) < 0.25 THEN 'low_topk_standardized_delta' END, CASE WHEN coalesce(most, 0) < 0.3 THEN 'low_max_standardized_delta' END], lambda v: v IS NOT NULL) AS short "
        "FROM rr LEFT JOIN sc USING (jid_a, jid_b)) SELECT jid_a, jid_b, reachability_score, len(short) > 0 AS too_alike, NOT hard_reject AND len(short) = 0 AS passes, array_to_string(CASE WHEN hard_reject THEN ['reachability_hard_reject'] ELSE [] END || short, ';') AS reasons FROM f",
        "pair_reading": f"WITH {stored}, r AS (SELECT a, b, round(p, 9) AS p, round(h, 9) AS h FROM s) SELECT a, b, round(abs(p - h), 6) AS discordance, CASE WHEN p IS NULL OR h IS NULL THEN 'not_assessed' WHEN round(abs(p - h), 9) < 0.05 THEN 'profile_agrees_with_neighbourhood' WHEN p >= h THEN 'profile_hides_differences' ELSE 'profile_stresses_differences' END AS reading FROM r",
        "physical_properties": f"{uni} SELECT jid, {', '.join(U.PHYSICAL)} FROM u WHERE {asked}",
        "external_properties": f"{uni} SELECT jid, {', '.join(U.PHYSICAL)} FROM u WHERE dataset_kind = 'external'",
        "query_profile": f"{uni}, {P.query_ctes()} SELECT * REPLACE (array_to_string(q_elements, ';') AS q_elements) FROM q",
        "reference_records": f"{P.with_pools()} SELECT query_id, pool_name, rank_in_pool, candidate_id, round(selection_score, 6) AS selection_score, chemical_system, prototype_family FROM p",
        "rank_weights": f"{P.with_pools()} SELECT query_id, pool_name, candidate_id, round(1 / log2(min(rank_in_pool) + 1), 6) AS weight FROM p GROUP BY 1, 2, 3",
    }
    fields = [c for c in U.PROFILE]
    whole = lambda c: f"round({c}, 6) AS {c}" if c in ("formation_energy", "energy_above_hull", "band_gap", "density_feature", "n_elements", "metal_count", "nonmetal_count") else f"array_to_string({c}, ';') AS {c}" if c == "elements" else c
    doubles = {"nonmetal_count": "nonmetal_count::DOUBLE"}
    out["profile_rows"] = f"{uni} SELECT jid, {', '.join(whole(c).replace('round(nonmetal_count', 'round(' + doubles['nonmetal_count']) for c in fields)}, round(({' + '.join(f'({c} IS NOT NULL)::INT' for c in fields)}) / {len(fields)}, 6) AS completeness FROM u WHERE {asked}"
    out["standard_vectors"] = f"{uni} " + " UNION ALL ".join(f"SELECT jid, {i}::INT AS place, round(({f}::DOUBLE - (SELECT avg({f}::DOUBLE) FROM u)) / (SELECT CASE WHEN stddev_pop({f}::DOUBLE) > 1e-12 THEN stddev_pop({f}::DOUBLE) ELSE 1.0 END FROM u), 6) AS value FROM u" for i, f in enumerate(P.FEATURES))
    deltas = f"{_with_controls_sql()},\n{_deltas_sql()}"
    group = "CASE " + " ".join(f"WHEN feature = '{f}' THEN '{U.GROUP_OF[f]}'" for f in P.FEATURES if f in U.GROUP_OF) + " ELSE 'other' END"
    out["stored_element_jaccard"] = f"{_with_controls_sql()}, n AS (SELECT DISTINCT candidate_id, neighbour_id FROM {NEIGHBOURS}) SELECT candidate_id, neighbour_id, least(candidate_id, neighbour_id) || '__' || greatest(candidate_id, neighbour_id) AS pair_key, CASE WHEN x.jid IS NOT NULL AND y.jid IS NOT NULL THEN round(len(list_intersect(x.elements, y.elements)) / nullif(len(list_distinct(x.elements || y.elements)), 0), 6) END AS jaccard FROM n LEFT JOIN uc x ON x.jid = candidate_id LEFT JOIN uc y ON y.jid = neighbour_id"
    out["stored_pair_deltas"] = f"{deltas} SELECT jid_a, jid_b, feature, round(delta, 6) AS delta FROM dl"
    out["stored_group_deltas"] = f"{deltas}, d AS (SELECT jid_a, jid_b, feature, round(delta, 9) AS delta, {group} AS feature_group FROM dl) SELECT jid_a, jid_b, feature_group, count(*) AS feature_count, round(avg(abs(delta)), 6) AS mean_abs_delta, round(max(abs(delta)), 6) AS max_abs_delta, round(avg(delta), 6) AS mean_signed_delta, arg_min(feature, {{'a': -abs(delta), 'b': feature}}) AS dominant_feature FROM d GROUP BY 1, 2, 3"
    out["stored_top_deltas"] = f"{deltas}, d AS (SELECT jid_a, jid_b, feature, round(delta, 9) AS delta FROM dl) SELECT jid_a, jid_b, feature, round(delta, 6) AS delta, row_number() OVER (PARTITION BY jid_a, jid_b ORDER BY abs(delta) DESC, feature)::INT AS delta_rank, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'unchanged' END AS direction FROM d WHERE abs(delta) >= 0.1 QUALIFY delta_rank <= 3"
    out["stored_pair_screen"] = f"{deltas}, s AS (SELECT jid_a, jid_b, count(*) AS feature_count, avg(abs(delta)) AS mean_delta, max(abs(delta)) AS max_delta, list_avg(list_sort(list(abs(delta)), 'DESC')[1:5]) AS topk_delta FROM dl GROUP BY 1, 2) SELECT jid_a, jid_b, feature_count, round(mean_delta, 6) AS mean_delta, round(max_delta, 6) AS max_delta, round(topk_delta, 6) AS topk_delta, feature_count >= 5 AND mean_delta >= 0.15 AND topk_delta >= 0.25 AND max_delta >= 0.3 AS passes FROM s"
    words = "('', 'unknown', 'unclassified', 'none', 'null', 'nan', 'n/a', 'na', 'not_available', 'not available')"
    cov = " + ".join(f"{w} * count(*) FILTER (lower(trim({c})) NOT IN {words}) / count(*)" for c, w in H.COVERAGE_WEIGHTS.items())
    ents = " UNION ALL ".join(f"SELECT query_id, '{c}' AS field, {c}::VARCHAR AS value FROM p WHERE {c} IS NOT NULL" for c in H.ENTROPY_FIELDS)
    out["pair_explanations"] = f"""{P.with_pools()}, cv AS (SELECT query_id, ({cov}) / {sum(H.COVERAGE_WEIGHTS.values())} AS cov FROM p GROUP BY 1),
vc AS (SELECT query_id, field, value, count(*) AS n FROM ({ents}) GROUP BY ALL), en AS (SELECT query_id, field, CASE WHEN count(*) = 1 THEN 0.0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END AS h FROM vc GROUP BY ALL),
pr AS (SELECT x.query_id AS a, y.query_id AS b, x.cov AS ca, y.cov AS cb FROM cv x JOIN cv y ON x.query_id < y.query_id), df AS (SELECT a, b, x.field, abs(x.h - y.h) AS d FROM pr JOIN en x ON x.query_id = a JOIN en y ON y.query_id = b AND y.field = x.field),
dd AS (SELECT a, b, avg(d) AS mean_d, arg_min(field, {{'a': -round(d, 9), 'b': field}}) AS widest FROM df GROUP BY 1, 2)
SELECT a, b, round(ca, 6) AS coverage_a, round(cb, 6) AS coverage_b, round(sqrt(sqrt(ca * cb)), 6) AS confidence, CASE WHEN round(sqrt(sqrt(ca * cb)), 9) >= 0.8 THEN 'high' WHEN round(sqrt(sqrt(ca * cb)), 9) >= 0.55 THEN 'moderate' ELSE 'low' END AS confidence_label, round(mean_d, 6) AS mean_entropy_difference, widest AS widest_field,
  CASE WHEN round(mean_d, 9) < 0.03 THEN 'very_similar' WHEN round(mean_d, 9) < 0.12 THEN 'modest_differences' ELSE 'substantial_differences' END AS diversity_reading FROM pr LEFT JOIN dd USING (a, b)"""
    out |= {"named_concepts": concept_sql.concepts_sql(), "bridge_diagnostics": concept_sql.bridge_sql(), "role_scores": concept_sql.roles_sql()}
    out["combined_similarity"] = _combined_sql()
    out["knn"] = _combined_sql("SELECT id, other, round(s, 6) AS similarity, neighbour_rank FROM k")
    out["distinctiveness"] = _combined_sql(
        ", d AS (SELECT id, min(1 - s) AS near, round(avg(1 - s), 9) AS mean FROM k GROUP BY 1) SELECT id, round(near, 6) AS nearest_distance, round(mean, 6) AS mean_distance, round((rank() OVER (ORDER BY mean) - 1 + (count(*) OVER (PARTITION BY mean) + 1) / 2) / count(*) OVER (), 6) AS percentile_rank FROM d"
    )
    edge = "combined_similarity >= 0.9 AND profile_similarity >= 0.8 AND neighbourhood_similarity >= 0.8"
    out["redundancy"] = _combined_sql(
        f", e AS MATERIALIZED (SELECT a AS u, b AS v FROM c4 WHERE {edge} UNION SELECT b, a FROM c4 WHERE {edge}), r AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), g AS (SELECT u AS id, min(v) AS root FROM r GROUP BY 1), "
        "z AS (SELECT root, count(*) AS group_size, row_number() OVER (ORDER BY count(*) DESC, root)::INT AS group_id FROM g GROUP BY 1) SELECT id, group_id, group_size FROM g JOIN z USING (root)"
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    # the strata overlap, and each draws by a hash of its own
    draws = " UNION ".join(f"(SELECT jid FROM u WHERE {where} ORDER BY ('0x' || sha256('{SAMPLE_SEED}:{name}:' || jid)[1:12])::BIGINT, jid LIMIT {n})" for name, where, n in STRATA)
    out["sample_regimes"] = f"{uni} SELECT jid, composition_family, dataset_kind FROM u WHERE jid IN (SELECT jid FROM ({draws}))"
    out["event_rates"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
    out["plausible_pairs"] = f"{uni}, {P._plausibility_ctes()} SELECT pair_label, count(*) AS n FROM pp GROUP BY 1"
    return out


def _combined_sql(then: str | None = None) -> str:
    head = len(P.with_pools())
    identity = K._identity_sql()[head:].lstrip(", \n").replace("round(j, 6) AS", "j AS").replace("round(CASE WHEN pool_score", "(CASE WHEN pool_score").replace("END, 6) AS identity_similarity", "END) AS identity_similarity")
    at = identity.rindex("SELECT a, b, j AS")
    identity = identity[:at].rstrip() + f",\nidn AS MATERIALIZED ({identity[at:]})"
    distribution = K._distribution_sql()[head:].lstrip(", \n").replace("round(sum(s * pw) / sum(pw), 6)", "sum(s * pw) / sum(pw)")
    distribution = distribution.replace(" ids AS (SELECT DISTINCT query_id FROM p),", "").replace("pr AS (SELECT x.query_id AS a, y.query_id AS b FROM ids x JOIN ids y ON x.query_id < y.query_id),\n", "")
    at = distribution.rindex("SELECT pr.a, pr.b")
    distribution = distribution[:at].rstrip() + f",\ndsn AS MATERIALIZED ({distribution[at:]})"
    return concept_sql.combined_sql(identity, distribution, then)
