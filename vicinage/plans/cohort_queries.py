"""Queries of evidence concepts, roles and cohort comparison, and of scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions import chemistry as C
from vicinage.functions import scalars as S
from vicinage.functions import similarity as X
from vicinage.operators import clustering as K
from vicinage.operators import cohort as H
from vicinage.operators import pool_metrics as M
from vicinage.operators import roles as Q
from vicinage.operators import universe as U
from vicinage.plans import retrieval_queries as P
from vicinage.plans.views import session_view
from vicinage.session import cut_lineage
from vicinage.sources import read_table


@session_view
def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pools = P.pools(spark, sf_dir)
    wide = cut_lineage(Q.by_query(M.metrics(pools)))
    return {"pools": pools, "queries": P.controls(spark, sf_dir), "wide": wide, "independence": M.independence(pools), "overlaps": M.overlaps(pools), "missing": M.missing_report(pools, P.REPORTED)}


@session_view
def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    return cut_lineage(Q.role_scores(e["wide"], e["queries"], e["overlaps"], e["independence"], e["missing"]))


@session_view
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    profiles = _roles(spark, sf_dir).join(e["queries"], "query_id")
    return cut_lineage(H.compare_all(e["pools"], e["wide"], profiles, measures=("hub_score", "boundary_score", "sufficiency", "profile_confidence"), reliability="profile_confidence"))


@session_view
def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(H.filled(H.both_ways(_pairs(spark, sf_dir), "combined_similarity")))


@session_view
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(K.cluster_cohort(_long(spark, sf_dir)))


def q_named_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    return P._rounded(Q.long_concepts(Q.named_concepts(e["wide"], e["independence"], e["missing"])))


def q_role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._rounded(_roles(spark, sf_dir))


def q_bridge_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._rounded(Q.bridge_diagnostics(_evidence(spark, sf_dir)["wide"]))


def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint's distinct references and the size of each pool."""
    f = H.fingerprint(P.pools(spark, sf_dir))
    return f.select("query_id", F.size("all_unique_reference_ids").alias("unique_references"), F.explode("pools").alias("pool_name", "pool")).select(
        "query_id", "unique_references", "pool_name", F.col("pool.row_count").alias("row_count"), F.element_at("pool.reference_ids_ranked", 1).alias("first_reference")
    )


def _id_pairs(pools: DataFrame) -> DataFrame:
    return H._all_pairs(pools.select("query_id").distinct(), 2_500)


def q_identity_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = P.pools(spark, sf_dir)
    return P._rounded(H.identity_similarity(pools, _id_pairs(pools)).select("a", "b", "all_reference_jaccard", "identity_similarity"))


def q_distribution_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = P.pools(spark, sf_dir)
    return P._rounded(H.distribution_similarity(pools, _id_pairs(pools)).select("a", "b", "distribution_similarity"))


def q_combined_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._rounded(H.explain_pairs(_pairs(spark, sf_dir)))


def q_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._rounded(H.nearest(_long(spark, sf_dir), 5))


def q_distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._rounded(H.distinctiveness(_long(spark, sf_dir), 5))


def q_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.redundancy(_pairs(spark, sf_dir))


def q_cohort_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters with each member's closeness to its own and the next cluster."""
    long = _long(spark, sf_dir)
    labels = _labels(spark, sf_dir)
    return P._rounded(H.between_clusters(long, labels))


def q_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    labels = _labels(spark, sf_dir)
    reliability = labels.select("id", F.lit(1.0).alias("reliability"))
    return P._rounded(H.cluster_summary(long, labels, reliability))


def q_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._rounded(K.scale_cohort(_long(spark, sf_dir)))


def q_reference_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.reference_frequency(P.pools(spark, sf_dir))


def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two similarities over all stored neighbour pairs."""
    return P._rounded(H.spearman(read_table(spark, sf_dir, "nearest_contextual_neighbours_1c2"), "profile_similarity", "reference_distribution_similarity"))


def q_tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the parsers of different stages read the stored texts of a field."""
    texts = read_table(spark, sf_dir, "candidate_pool").select(F.col("stability_label").alias("value")).distinct()
    return texts.select("value", S.support_flag(F.col("value")).alias("support"), S.plausibility_flag(F.col("value")).alias("plausibility"), S.strict_flag(F.col("value")).alias("strict"), S.metric_flag(F.col("value")).alias("metric"), S.truthy(F.col("value")).alias("truthy"))


def q_alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read_table(spark, sf_dir, "structural_context_batch_summary")
    return cases.select(
        "case_id",
        S.first_text(cases, ["External_ID", "jid"]).alias("first_id"),
        S.first_number(cases, ["absent", "local_context_support", "structural_regime_contrast"]).alias("first_measure"),
        S.clip01(F.col("structural_regime_contrast")).alias("clipped"),
        S.clip01_or_zero(F.col("local_context_support")).alias("clipped_or_zero"),
        S.missing_list(["jid", "external_id", "profile_quality_flags"]).alias("missing"),
        S.slug(F.col("output_dir")).alias("slug"),
    ).distinct()


def q_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", S.at_path(F.col("props"), "absent.path", "k").cast("int").alias("k"))


def q_formula_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "material_record").select("jid", S.text_or_null(F.col("formula")).alias("formula")).filter("formula is not null").distinct()
    return rows.select("jid", "formula", F.array_join(C.symbols_of_formula(F.col("formula")), "-").alias("symbols"), F.explode(C.formula_counts(F.col("formula"))).alias("element", "amount"))


def q_composition_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = P.universe(spark, sf_dir)
    return base.select("jid", C.composition_family(F.col("elements")).alias("store_family"), C.external_composition_family(F.col("elements")).alias("external_family"), S.stable_fraction(451, F.col("jid")).alias("jitter"))


def q_element_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element overlap of all stored neighbour pairs; null where an id is unknown."""
    sets = P.with_controls(spark, sf_dir).select("jid", "elements")
    pairs = read_table(spark, sf_dir, "nearest_contextual_neighbours_1c2").select("candidate_id", "neighbour_id").distinct()
    both = pairs.join(sets.select(F.col("jid").alias("candidate_id"), F.col("elements").alias("x")), "candidate_id", "left").join(sets.select(F.col("jid").alias("neighbour_id"), F.col("elements").alias("y")), "neighbour_id", "left")
    return P._rounded(both.select("candidate_id", "neighbour_id", S.pair_key(F.col("candidate_id"), F.col("neighbour_id")).alias("pair_key"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), X.jaccard(F.col("x"), F.col("y"))).alias("jaccard")))


def q_case_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that need review, with their reasons; one row per case."""
    cases = read_table(spark, sf_dir, "structural_context_batch_summary")
    one = U.keep_first(cases, ["case_id"], [F.col(c).asc_nulls_first() for c in ("finished_at", "loaded_at", "batch_index")])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("evidence_sufficiency_status") != "sufficient", F.lit("limited_evidence")),
            F.when(F.col("profile_confidence") < 0.35, F.lit("low_confidence")),
            F.when(S.clip01(F.col("local_context_support")).isNull() | S.clip01(F.col("structural_regime_contrast")).isNull(), F.lit("missing_measure")),
        )
    )
    return one.withColumn("reasons", F.array_join(reasons, ";")).filter(F.col("reasons") != "").select("case_id", "reasons")


def queries() -> dict:
    plain = [q_named_concepts, q_role_scores, q_bridge_diagnostics, q_fingerprints, q_identity_similarity, q_distribution_similarity, q_combined_similarity, q_knn, q_distinctiveness, q_redundancy, q_cohort_clusters, q_cluster_summary, q_scaling, q_reference_frequency, q_spearman]
    plain += [q_tri_state, q_alias_coalesce, q_json_path, q_formula_tokens, q_composition_family, q_element_jaccard, q_case_review]
    return {q.__name__.removeprefix("q_"): q for q in plain}


def _identity_sql() -> str:
    w = H.POOL_WEIGHTS
    pool = " UNION ALL ".join(f"SELECT '{p}' AS pool_name, {v} AS w" for p, v in w.items())
    return f"""{P.with_pools()}, pw AS ({pool}),
rk AS MATERIALIZED (SELECT query_id, pool_name, candidate_id, 1 / log2(min(rank_in_pool) + 1) AS w FROM p GROUP BY 1, 2, 3),
ids AS (SELECT DISTINCT query_id FROM p), pr AS MATERIALIZED (SELECT x.query_id AS a, y.query_id AS b FROM ids x JOIN ids y ON x.query_id < y.query_id),
keys AS (SELECT a, b, pw.pool_name, pw.w AS pool_w, candidate_id FROM pr CROSS JOIN pw JOIN rk ON rk.pool_name = pw.pool_name AND rk.query_id IN (a, b) GROUP BY ALL),
wj AS (SELECT a, b, keys.pool_name, any_value(pool_w) AS pool_w, sum(least(coalesce(x.w, 0), coalesce(y.w, 0))) / sum(greatest(coalesce(x.w, 0), coalesce(y.w, 0))) AS s FROM keys
  LEFT JOIN rk x ON x.query_id = a AND x.pool_name = keys.pool_name AND x.candidate_id = keys.candidate_id LEFT JOIN rk y ON y.query_id = b AND y.pool_name = keys.pool_name AND y.candidate_id = keys.candidate_id GROUP BY 1, 2, 3),
ps AS (SELECT a, b, sum(s * pool_w) / sum(pool_w) AS pool_score FROM wj GROUP BY 1, 2),
al AS (SELECT query_id, list_distinct(list(candidate_id)) AS c FROM p GROUP BY 1),
ja AS (SELECT a, b, len(list_intersect(x.c, y.c)) / len(list_distinct(x.c || y.c)) AS j FROM pr JOIN al x ON x.query_id = a JOIN al y ON y.query_id = b)
SELECT a, b, round(j, 6) AS all_reference_jaccard, round(CASE WHEN pool_score IS NULL THEN j ELSE 0.8 * pool_score + 0.2 * j END, 6) AS identity_similarity FROM ja LEFT JOIN ps USING (a, b)"""


def _distribution_sql() -> str:
    grid = " UNION ALL ".join(f"SELECT '{p}' AS pool_name, {pv} AS pw, '{f}' AS field, {fv} AS fw" for p, pv in H.POOL_WEIGHTS.items() for f, fv in H.FIELD_WEIGHTS.items())
    unions = " UNION ALL ".join(f"SELECT query_id, pool_name, '{f}' AS field, {f}::VARCHAR AS value FROM p WHERE {f} IS NOT NULL" for f in H.FIELD_WEIGHTS)
    return f"""{P.with_pools()}, gr AS ({grid}),
sh AS MATERIALIZED (SELECT *, n / sum(n) OVER (PARTITION BY query_id, pool_name, field) AS s FROM (SELECT query_id, pool_name, field, value, count(*) AS n FROM ({unions}) GROUP BY ALL)),
hv AS (SELECT DISTINCT query_id, pool_name, field FROM sh), ids AS (SELECT DISTINCT query_id FROM p),
pr AS (SELECT x.query_id AS a, y.query_id AS b FROM ids x JOIN ids y ON x.query_id < y.query_id),
ks AS MATERIALIZED (SELECT a, b, gr.pool_name, pw, gr.field, fw, value FROM pr CROSS JOIN gr JOIN sh ON sh.pool_name = gr.pool_name AND sh.field = gr.field AND sh.query_id IN (a, b) GROUP BY ALL),
js AS (SELECT a, b, pool_name, field, any_value(pw) AS pw, any_value(fw) AS fw, bool_or(xs > 0) AS ha, bool_or(ys > 0) AS hb,
   0.5 * sum(CASE WHEN xs > 0 THEN xs * log2(xs / ((xs + ys) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN ys > 0 THEN ys * log2(ys / ((xs + ys) / 2)) ELSE 0 END) AS d FROM
  (SELECT ks.*, coalesce(x.s, 0) AS xs, coalesce(y.s, 0) AS ys FROM ks LEFT JOIN sh x ON x.query_id = a AND x.pool_name = ks.pool_name AND x.field = ks.field AND x.value = ks.value
     LEFT JOIN sh y ON y.query_id = b AND y.pool_name = ks.pool_name AND y.field = ks.field AND y.value = ks.value) GROUP BY 1, 2, 3, 4),
fs AS (SELECT a, b, pool_name, any_value(pw) AS pw, sum(fw * CASE WHEN ha AND hb THEN greatest(0, least(1, 1 - sqrt(greatest(d, 0)))) ELSE 0 END) / sum(fw) AS s FROM js GROUP BY 1, 2, 3)
SELECT pr.a, pr.b, round(sum(s * pw) / sum(pw), 6) AS distribution_similarity FROM pr LEFT JOIN fs USING (a, b) GROUP BY 1, 2"""


def _bool_sql(column: str, yes, no, *, null=(), other: str) -> str:
    low = f"lower(trim({column}))"
    nulls = f"{column} IS NULL" + (f" OR {low} IN {P._in(null)}" if null else "")
    yes_ = f"WHEN {low} IN {P._in(yes)} THEN true " if yes else ""
    return f"CASE WHEN {nulls} THEN NULL {yes_}WHEN {low} IN {P._in(no)} THEN false ELSE {other} END"


def oracle_sql() -> dict[str, str]:
    none = ("", "unknown", *S.NULL_WORDS)
    uni = f"WITH {P.universe_ctes()}"
    finite = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
    clip = lambda c: f"CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL ELSE least(greatest({c}, 0.0), 1.0) END"
    return {
        "fingerprints": f"{P.with_pools()}, n AS (SELECT query_id, count(DISTINCT candidate_id)::INT AS unique_references FROM p GROUP BY 1) SELECT query_id, unique_references, pool_name, count(*)::INT AS row_count, arg_min(candidate_id, rank_in_pool) AS first_reference FROM p JOIN n USING (query_id) GROUP BY 1, 2, 3",
        "identity_similarity": _identity_sql(),
        "distribution_similarity": _distribution_sql(),
        "reference_frequency": f"{P.with_pools()} SELECT candidate_id, count(DISTINCT query_id) AS query_count, count(DISTINCT pool_name) AS pool_count, count(DISTINCT query_id) = 1 AS exclusive FROM p GROUP BY 1",
        "spearman": "WITH r AS (SELECT profile_similarity AS x, reference_distribution_similarity AS y FROM nearest_contextual_neighbours_1c2 WHERE profile_similarity IS NOT NULL AND NOT isnan(profile_similarity) AND reference_distribution_similarity IS NOT NULL AND NOT isnan(reference_distribution_similarity)), "
        "k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM r) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k",
        "tri_state": f"SELECT DISTINCT stability_label AS value, {_bool_sql('stability_label', (), S.SUPPORT_NO, null=none, other='true')} AS support, {_bool_sql('stability_label', (), S.PLAUSIBILITY_NO, null=none, other='true')} AS plausibility, "
        f"{_bool_sql('stability_label', S.STRICT_YES, S.STRICT_NO, other='NULL')} AS strict, {_bool_sql('stability_label', ('true', '1', 'yes', 'y'), ('false', '0', 'no', 'n'), other='NULL')} AS metric, coalesce(lower(trim(stability_label)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS truthy FROM candidate_pool",
        "alias_coalesce": f"SELECT DISTINCT case_id, coalesce(nullif(trim(external_id), ''), nullif(trim(jid), '')) AS first_id, coalesce({finite('local_context_support')}, {finite('structural_regime_contrast')}) AS first_measure, {clip('structural_regime_contrast')} AS clipped, coalesce({clip('local_context_support')}, 0.0) AS clipped_or_zero, "
        "array_to_string(list_filter([CASE WHEN jid IS NULL THEN 'jid' END, CASE WHEN external_id IS NULL THEN 'external_id' END, CASE WHEN profile_quality_flags IS NULL THEN 'profile_quality_flags' END], lambda x: x IS NOT NULL), ';') AS missing, "
        "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(output_dir), '[^A-Za-z0-9_.=\\-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'case') AS slug FROM structural_context_batch_summary",
        "json_path": "SELECT event_id, coalesce(json_extract_string(props, '$.absent.path'), json_extract_string(props, '$.k'))::INT AS k FROM events",
        "formula_tokens": "WITH r AS (SELECT DISTINCT jid, nullif(trim(formula), '') AS formula FROM material_record), t AS (SELECT jid, formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 2)) AS x FROM r WHERE formula IS NOT NULL) "
        "SELECT jid, formula, array_to_string(list_sort(list_distinct(regexp_extract_all(formula, '[A-Z][a-z]?'))), '-') AS symbols, element, sum(coalesce(try_cast(nullif(x, '') AS DOUBLE), 1)) AS amount FROM t GROUP BY jid, formula, element",
        "composition_family": f"{uni} SELECT jid, composition_family AS store_family, CASE WHEN len(elements) = 0 THEN 'unknown_composition' WHEN nonmetal_count > 0 AND nonmetal_count < len(elements) THEN 'mixed_metal_nonmetal' WHEN nonmetal_count = 0 THEN 'metallic_or_intermetallic' ELSE 'nonmetallic' END AS external_family, ('0x' || sha256('451:' || jid)[1:12])::BIGINT / 281474976710656.0::DOUBLE AS jitter FROM u",
        "element_jaccard": f"{uni}, n AS (SELECT DISTINCT candidate_id, neighbour_id FROM nearest_contextual_neighbours_1c2) SELECT candidate_id, neighbour_id, least(candidate_id, neighbour_id) || '__' || greatest(candidate_id, neighbour_id) AS pair_key, round(len(list_intersect(x.elements, y.elements)) / nullif(len(list_distinct(x.elements || y.elements)), 0), 6) AS jaccard FROM n JOIN u x ON x.jid = candidate_id JOIN u y ON y.jid = neighbour_id",
        "case_review": "WITH o AS (SELECT * FROM structural_context_batch_summary QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY finished_at NULLS FIRST, loaded_at NULLS FIRST, batch_index NULLS FIRST) = 1), "
        "r AS (SELECT case_id, array_to_string(list_filter([CASE WHEN evidence_sufficiency_status != 'sufficient' THEN 'limited_evidence' END, CASE WHEN profile_confidence < 0.35 THEN 'low_confidence' END, CASE WHEN local_context_support IS NULL OR isnan(local_context_support) OR structural_regime_contrast IS NULL OR isnan(structural_regime_contrast) THEN 'missing_measure' END], lambda x: x IS NOT NULL), ';') AS reasons FROM o) SELECT * FROM r WHERE reasons != ''",
    }
