"""Queries of the universe, retrieval, pool metrics and plausibility, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.chemistry import BATTERY_SPINELS, CHALCOGENS, CRYSTAL_SYSTEM_ENDS, FLUORITE_CATIONS, HALOGENS, KNOWN_PYROCHLORES, KNOWN_SPINELS, MIXED_VALENCE_SPINELS, NONMETALS, OXIDE_RULES, crystal_system_code
from vicinage.operators import plausibility as P
from vicinage.operators import pool_metrics as M
from vicinage.operators import pool_scan as PS
from vicinage.operators import retrieval as R
from vicinage.operators import universe as U
from vicinage.plans.views import session_view
from vicinage.session import cut_lineage
from vicinage.sources import read_table

REPORTED = ("formula", "spacegroup_symbol", *R.FLAGS, "spacegroup_number", "crystal_system_code", "formation_energy", "energy_above_hull", "known_synthesized", "n_symmetry_ops")
CONFIG = R.PoolConfig()


@session_view
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe of all materials, deduplicated, with known statuses and family labels."""
    records = U.prepare(read_table(spark, sf_dir, "material_record"), keep=["loaded_at"])
    first = U.union_universe([records], first_by=["loaded_at"]).drop("loaded_at")
    known = U.last_status(read_table(spark, sf_dir, "candidate_pool"), key="candidate_jid", status="known_synthesized", order=["loaded_at"])
    return cut_lineage(U.with_families(U.known_overlay(first, known.withColumnRenamed("candidate_jid", "jid"))))


@session_view
def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control materials as queries; each takes the most common space group of its composition family."""
    prepared = U.prepare(read_table(spark, sf_dir, "control_materials"))
    common = universe(spark, sf_dir).filter("spacegroup_number is not null").groupBy("composition_family", "spacegroup_number").count()
    common = common.groupBy("composition_family").agg(F.min_by("spacegroup_number", F.struct(-F.col("count"), F.col("spacegroup_number"))).alias("sg"))
    seated = prepared.join(common, "composition_family", "left").withColumn("spacegroup_number", F.coalesce("spacegroup_number", "sg")).drop("sg")
    return cut_lineage(R.query_rows(U.with_families(seated.withColumn("crystal_system_code", crystal_system_code(F.col("spacegroup_number"))))))


@session_view
def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pools of all control materials."""
    return cut_lineage(R.in_blocks(universe(spark, sf_dir), controls(spark, sf_dir), CONFIG))


@session_view
def material_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materials whose id number is divisible by 20 as queries, with their own space group and status."""
    number = F.regexp_extract("jid", r"^JVASP-(\d+)$", 1).try_cast("long")
    return cut_lineage(R.query_rows(universe(spark, sf_dir).filter(number % 20 == 0)))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe(spark, sf_dir).withColumn("elements", F.array_join("elements", ";"))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.manifest(universe(spark, sf_dir))


POOL_OUT = ["query_id", "candidate_id", "pool_name", "rank_in_pool", "selection_score", "element_overlap_count", "same_chemical_system", "same_prototype_family", "same_material_family", "symmetry_distance", "is_stable_or_known", "missing_fields"]


def _one_pool(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pools(spark, sf_dir).filter(F.col("pool_name") == name).select(*POOL_OUT)

    run.__doc__ = f"The {name} pools of all control materials."
    return run


def q_material_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pools of every material whose id number is divisible by 20."""
    return PS.chosen(universe(spark, sf_dir), material_queries(spark, sf_dir), CONFIG).select(*POOL_OUT)


def q_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rates of every query against the whole universe."""
    both = R.annotate(universe(spark, sf_dir), controls(spark, sf_dir), CONFIG)
    return _rounded(both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"same_{c}").cast("long")).alias(f"same_{c}") for c in R.FLAGS], F.sum("element_overlap_count").alias("overlap"), F.sum(F.col("symmetry_match").cast("long")).alias("symmetry_matches"), F.avg("symmetry_distance").alias("mean_distance")))


def q_pool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.metrics(pools(spark, sf_dir)))


def q_pool_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.entropies(M.value_counts(pools(spark, sf_dir), M.CATEGORIES)))


def q_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.top_categories(M.value_counts(pools(spark, sf_dir), M.CATEGORIES, meaningful=True)))


def q_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.missing_report(pools(spark, sf_dir), REPORTED))


def q_pool_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlaps(pools(spark, sf_dir))


def q_pool_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.independence(pools(spark, sf_dir)))


def q_top_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.top_references(pools(spark, sf_dir)))


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.coverage(pools(spark, sf_dir), ["prototype_family", "structure_variant", "formula_family", "composition_family"]))


def q_pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.pool_summary(pools(spark, sf_dir)))


@session_view
def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(P.annotate_records(universe(spark, sf_dir)))


def q_plausibility_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _annotated(spark, sf_dir).select("jid", "physical_label", "physical_score", F.array_join("physical_flags", ";").alias("physical_flags"), "physical_completeness")
    return _rounded(out)


def _neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nearest_contextual_neighbours_1c2").select("candidate_id", "neighbour_id").distinct()


def q_plausibility_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair labels of all distinct neighbour pairs, of those that pass the soft filter."""
    pairs = P.soft_filter(P.annotate_pairs(_neighbour_pairs(spark, sf_dir), _annotated(spark, sf_dir), a="candidate_id", b="neighbour_id"))
    return _rounded(pairs.select("candidate_id", "neighbour_id", "pair_label", "pair_score", "pair_completeness"))


def q_plausibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.annotate_pairs(_neighbour_pairs(spark, sf_dir), _annotated(spark, sf_dir), a="candidate_id", b="neighbour_id")
    return _rounded(P.summarise_pairs(pairs, order=["candidate_id", "neighbour_id"]))


FEATURES = ("band_gap", "formation_energy", "density_feature", "spacegroup_number", "n_elements", "metal_count", "nonmetal_count")


def q_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.feature_stats(universe(spark, sf_dir), FEATURES))


def q_zscore_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.feature_matrix(universe(spark, sf_dir), ("band_gap", "formation_energy", "density_feature", "spacegroup_number")))


def with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe and the control materials, to which stored pairs refer as well."""
    put = U.union_universe([U.prepare(read_table(spark, sf_dir, "control_materials"))])
    return U.upsert(universe(spark, sf_dir), put, overwrite=False)


@session_view
def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of all stored pairs, in deviations of the universe; an unknown id has no values and so no rows."""
    base = universe(spark, sf_dir)
    pairs = _neighbour_pairs(spark, sf_dir).select(F.col("candidate_id").alias("jid_a"), F.col("neighbour_id").alias("jid_b")).filter("jid_a != jid_b")
    return cut_lineage(U.signed_deltas(pairs, with_controls(spark, sf_dir), U.feature_stats(base, FEATURES), FEATURES))


def q_pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_deltas(spark, sf_dir))


def q_group_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.grouped_deltas(_deltas(spark, sf_dir).withColumn("delta", F.round("delta", 9))))


def q_top_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.top_deltas(_deltas(spark, sf_dir).withColumn("delta", F.round("delta", 9)), 3, least=0.1))


def q_pair_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.pair_screen(_deltas(spark, sf_dir)))


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe with the control materials put in and the externals taken out."""
    base = universe(spark, sf_dir).select("jid", "formula", "chemical_system", "composition_family", "dataset_kind")
    put = U.prepare(read_table(spark, sf_dir, "control_materials")).select("jid", "formula", "chemical_system", "composition_family")
    return U.remove(U.upsert(base, put), base.filter("dataset_kind = 'external'").select("jid"))


def queries() -> dict:
    named = {f"{name}_pool": _one_pool(name) for name in R.POOLS}
    plain = [q_universe, q_manifest, q_material_pools, q_annotate, q_pool_metrics, q_pool_entropy, q_top_categories, q_missing_report, q_pool_overlap, q_pool_independence, q_top_references, q_coverage, q_pool_summary]
    plain += [q_plausibility_records, q_plausibility_pairs, q_plausibility_summary, q_feature_stats, q_zscore_matrix, q_pair_deltas, q_group_deltas, q_top_deltas, q_pair_screen, q_upsert]
    return named | {q.__name__.removeprefix("q_"): q for q in plain}


# ---------------------------------------------------------------- SQL


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def prepared_sql(table: str, *, has: tuple[str, ...]) -> str:
    """A SELECT that cleans a table as :func:`vicinage.operators.universe.prepare` does."""
    text = lambda n: f"nullif(trim({n}), '')" if n in has else "NULL::VARCHAR"
    number = lambda n: f"CASE WHEN isfinite({n}::DOUBLE) THEN {n}::DOUBLE END" if n in has else "NULL::DOUBLE"
    cleaned = r"list_sort(list_distinct(list_filter(list_transform(list_filter(elements, lambda e: e IS NOT NULL), lambda e: regexp_extract(e, '^[\s\p{Z}]*([A-Za-z]{1,2})(?:[^A-Za-z]|$)', 1)), lambda s: s != '')))" if "elements" in has else "[]::VARCHAR[]"
    cased = "list_sort(list_distinct(list_transform(raw, lambda s: upper(s[1]) || lower(s[2:]))))"
    of_formula = "list_sort(list_distinct(regexp_extract_all(formula, '[A-Z][a-z]?')))"
    sgn = "spacegroup_number"
    system_code = "CASE WHEN NOT spacegroup_number BETWEEN 1 AND 230 THEN NULL " + " ".join(f"WHEN spacegroup_number <= {end} THEN {i}" for i, end in enumerate(CRYSTAL_SYSTEM_ENDS, 1)) + " END"
    family = (
        f"CASE WHEN len(elements) = 0 THEN NULL WHEN len(elements) = 1 THEN 'elemental' WHEN list_contains(elements, 'O') THEN 'oxide' WHEN list_has_any(elements, {list(HALOGENS)}) THEN 'halide' "
        f"WHEN list_has_any(elements, {list(CHALCOGENS)}) THEN 'chalcogenide' WHEN metal_count >= 2 AND metal_count = len(elements) THEN 'intermetallic' ELSE 'mixed_compound' END"
    )
    return f"""
 (SELECT *, {family} AS composition_family, {system_code} AS crystal_system_code, len(elements)::DOUBLE AS n_elements, len(elements) - metal_count AS nonmetal_count, nullif(array_to_string(elements, '-'), '') AS chemical_system FROM
  (SELECT *, len(list_filter(elements, lambda s: s NOT IN {_in(NONMETALS)}))::DOUBLE AS metal_count FROM
   (SELECT * EXCLUDE (raw), coalesce(CASE WHEN len(raw) > 0 THEN {cased} ELSE {of_formula} END, []::VARCHAR[]) AS elements FROM
    (SELECT jid, coalesce({text('reduced_formula')}, {text('formula')}) AS formula, {text('material_type')} AS material_type, {text('dataset_kind')} AS dataset_kind, {cleaned} AS raw, NULL::VARCHAR AS spacegroup_symbol,
       {sgn + '::INT' if sgn in has else 'NULL::INT'} AS spacegroup_number, {number('formation_energy_peratom')} AS formation_energy, {number('optb88vdw_bandgap')} AS band_gap, {number('density')} AS density_feature, {number('energy_above_hull')} AS energy_above_hull,
       {'loaded_at' if 'loaded_at' in has else 'NULL::TIMESTAMP'} AS loaded_at FROM {table}))))"""


def families_sql(rows: str) -> str:
    """``rows`` with the labels of the rule-based classifier, from the same rule table."""
    compact = "replace(coalesce(formula, ''), ' ', '')"
    has = lambda e: f"coalesce(list_contains(syms, '{e}'), false)"
    variant, conf, fam = {}, {}, {}
    for name, (label, base, unknown, sites) in OXIDE_RULES.items():
        v, c = [], []
        for numbers, symbols, its_variant, its_conf in sites:
            here = f"coalesce(spacegroup_number IN {_in(numbers)}, false)" + (f" OR coalesce(lower(spacegroup_symbol) IN {_in(symbols)}, false)" if symbols else "")
            value, score = f"'{its_variant}'", str(its_conf)
            if its_variant == "cubic_spinel":
                value = f"CASE WHEN {compact} IN {_in(MIXED_VALENCE_SPINELS)} THEN 'cubic_mixed_valence_or_inverse_spinel' WHEN {compact} IN {_in(BATTERY_SPINELS)} THEN 'cubic_battery_spinel' ELSE 'cubic_spinel' END"
            if its_variant == "distorted_spinel_derivative":
                value = f"CASE WHEN {compact} IN {_in(BATTERY_SPINELS)} THEN 'distorted_battery_spinel_derivative' ELSE '{its_variant}' END"
                score = f"CASE WHEN {compact} IN {_in(BATTERY_SPINELS)} THEN 0.82 ELSE {its_conf} END"
            v.append(f"WHEN {here} THEN {value}")
            c.append(f"WHEN {here} THEN {score}")
        variant[name] = f"CASE {' '.join(v)} ELSE '{unknown}' END"
        floor = str(base)
        if name == "AB2O4":
            floor = f"CASE WHEN {compact} IN {_in(KNOWN_SPINELS)} THEN 0.74 ELSE {base} END"
        elif name == "A2B2O7":
            floor = f"CASE WHEN {compact} IN {_in(KNOWN_PYROCHLORES)} THEN 0.76 ELSE {base} END"
        elif name == "AO2":
            floor = f"CASE WHEN cation THEN 0.70 ELSE {base} END"
        conf[name] = f"greatest({floor}, CASE {' '.join(c)} ELSE 0 END, 0.35)"
        fam[name] = label
    cases = lambda d: "CASE " + " ".join(f"WHEN grp = '{k}' THEN {x}" for k, x in d.items())
    fl_numbers = sorted({n for r in OXIDE_RULES["AO2"][3] for n in r[0]})
    return f"""
 (SELECT * EXCLUDE (syms, nums, oxy, rest_n, rest_c, all_c, anon, cation, oxide, grp, layered, maxp, ff, conf0, conf1, pf, sv, cls),
    coalesce(composition_family, cls) AS material_family, coalesce(ff, CASE WHEN layered THEN 'AB2' END, 'unknown') AS formula_family,
    coalesce(pf, CASE WHEN layered THEN 'dichalcogenide_like' END, CASE WHEN maxp THEN 'max_phase_like' END, 'unknown') AS prototype_family,
    coalesce(sv, CASE WHEN layered THEN 'layered_chalcogenide_candidate' END, CASE WHEN maxp THEN 'layered_carbide_nitride_candidate' END, 'unknown') AS structure_variant,
    round(CASE WHEN maxp THEN greatest(conf1, 0.58) ELSE conf1 END, 4)::DOUBLE AS family_confidence, cls AS classified_family FROM
 (SELECT *, CASE WHEN layered THEN greatest(conf0, 0.62) ELSE conf0 END AS conf1,
    CASE WHEN maxp THEN 'max_phase_like' WHEN layered THEN 'dichalcogenide_like' ELSE coalesce(pf, composition_family, 'unknown') END AS cls FROM
 (SELECT *, {cases({k: f"'{v}'" for k, v in fam.items()})} END AS pf, {cases(variant)} END AS sv, {cases(conf)} ELSE 0.35 END AS conf0,
    coalesce(NOT oxide AND ({has('S')} OR {has('Se')} OR {has('Te')}) AND all_c = '1,2', false) AS layered,
    coalesce(({has('C')} OR {has('N')}) AND len(syms) = 3 AND all_c IN ('1,2,3', '1,1,2', '1,3,4'), false) AS maxp FROM
 (SELECT *, CASE WHEN oxide AND ff = 'ABO3' THEN 'ABO3' WHEN oxide AND ff = 'AB2O4' THEN 'AB2O4' WHEN oxide AND ff = 'A2B2O7' THEN 'A2B2O7'
    WHEN oxide AND ff IN ('AO2', 'AB2') AND (cation OR coalesce(spacegroup_number IN {_in(fl_numbers)}, false)) THEN 'AO2' END AS grp FROM
 (SELECT *, CASE WHEN rest_c = '1,1' AND oxy = 3 THEN 'ABO3' WHEN rest_c = '1,2' AND oxy = 4 THEN 'AB2O4' WHEN rest_c = '3' AND oxy = 4 AND {compact} IN {_in(MIXED_VALENCE_SPINELS)} THEN 'AB2O4'
    WHEN rest_c = '2,2' AND oxy = 7 THEN 'A2B2O7' WHEN rest_c = '1' AND oxy = 2 THEN 'AO2' WHEN anon != '' THEN anon WHEN rest_n >= 1 AND oxy > 0 THEN 'oxide_formula' END AS ff,
    coalesce(composition_family = 'oxide', false) OR {has('O')} AS oxide, coalesce(list_has_any(syms, {list(FLUORITE_CATIONS)}), false) AS cation FROM
 (SELECT u.*, syms, nums, oxy, coalesce(rest_n, 0) AS rest_n, rest_c, all_c, anon FROM {rows} u LEFT JOIN
   (SELECT * EXCLUDE (dv), array_to_string(list_transform(nums, lambda n, i: chr((64 + i)::INT) || CASE WHEN n = dv THEN '' ELSE (n // dv)::VARCHAR END), '') AS anon FROM
   (SELECT *, list_reduce(nums, lambda a, b: gcd(a, b)) AS dv FROM
   (SELECT jid, list(e ORDER BY e) AS syms, list(n ORDER BY n) AS nums, max(n) FILTER (e = 'O') AS oxy, count(*) FILTER (e != 'O') AS rest_n, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (e != 'O'), '') AS rest_c,
      string_agg(n::VARCHAR, ',' ORDER BY n) AS all_c
    FROM (SELECT jid, e, sum(coalesce(try_cast(nullif(x, '') AS DOUBLE), 1))::BIGINT AS n FROM
      (SELECT jid, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)) AS e, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 2)) AS x FROM {rows}) GROUP BY 1, 2)
    GROUP BY jid))) f USING (jid)))))))"""


_MATERIAL_COLUMNS = ("reduced_formula", "formula", "material_type", "dataset_kind", "elements", "spacegroup_number", "formation_energy_peratom", "optb88vdw_bandgap", "density", "energy_above_hull", "loaded_at")


def universe_ctes() -> str:
    order = "loaded_at, formula, material_type, dataset_kind, elements, spacegroup_symbol, spacegroup_number, formation_energy, band_gap, density_feature, energy_above_hull"
    order = ", ".join(f"{c.strip()} NULLS FIRST" for c in order.split(","))
    return f"""
up AS MATERIALIZED (SELECT * FROM {prepared_sql('material_record', has=_MATERIAL_COLUMNS)}),
ud AS (SELECT * EXCLUDE (loaded_at) FROM up QUALIFY row_number() OVER (PARTITION BY jid ORDER BY {order}) = 1),
kn AS (SELECT candidate_jid AS jid, known_synthesized FROM candidate_pool WHERE candidate_jid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_jid ORDER BY loaded_at DESC NULLS LAST, known_synthesized DESC NULLS LAST) = 1),
uk AS MATERIALIZED (SELECT ud.*, kn.known_synthesized FROM ud LEFT JOIN kn USING (jid)),
u AS MATERIALIZED (SELECT * FROM {families_sql('uk')})"""


def query_ctes() -> str:
    code = "CASE WHEN NOT spacegroup_number BETWEEN 1 AND 230 THEN NULL " + " ".join(f"WHEN spacegroup_number <= {end} THEN {i}" for i, end in enumerate(CRYSTAL_SYSTEM_ENDS, 1)) + " END"
    return f"""
cp AS (SELECT * EXCLUDE (spacegroup_number, crystal_system_code, loaded_at) FROM {prepared_sql('control_materials', has=('formula',))}),
sg AS (SELECT composition_family, spacegroup_number FROM (SELECT composition_family, spacegroup_number, count(*) AS n FROM u WHERE spacegroup_number IS NOT NULL GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY composition_family ORDER BY n DESC, spacegroup_number) = 1),
cs AS MATERIALIZED (SELECT *, {code} AS crystal_system_code, NULL::BOOLEAN AS known_synthesized FROM (SELECT cp.*, sg.spacegroup_number FROM cp LEFT JOIN sg USING (composition_family))),
cf AS MATERIALIZED (SELECT * FROM {families_sql('cs')}),
q AS MATERIALIZED (SELECT jid AS query_id, formula AS query_formula, elements AS q_elements, spacegroup_number AS q_spacegroup_number, crystal_system_code AS q_crystal_system_code,
  {', '.join(f"nullif(trim({c}), '') AS q_{c}" for c in R.FLAGS if c != 'material_family')}, coalesce(classified_family, material_family) AS q_material_family FROM cf),
a AS MATERIALIZED (SELECT *, ov AS element_overlap_count, ov / greatest(len(q_elements), 1) AS fr, coalesce(dist = 0, false) AS symmetry_match, dist AS symmetry_distance,
  coalesce(energy_above_hull <= 0.1, false) OR coalesce(known_synthesized, false) AS is_stable_or_known FROM
  (SELECT u.* RENAME (jid AS candidate_id), q.*, len(list_intersect(u.elements, q.q_elements)) AS ov,
   (CASE WHEN q_spacegroup_number IS NOT NULL THEN abs(spacegroup_number - q_spacegroup_number) ELSE abs(crystal_system_code - q_crystal_system_code) END)::DOUBLE AS dist,
   {', '.join(f'coalesce(u.{c} = q.q_{c}, false) AS same_{c}' for c in R.FLAGS)} FROM u CROSS JOIN q WHERE u.jid != q.query_id))"""


def pool_ctes() -> str:
    s = {c: f"same_{c}::INT" for c in R.FLAGS}
    any_ = " OR ".join(f"same_{c}" for c in R.FLAGS)
    related = "(same_material_family OR same_formula_family OR same_prototype_family OR same_composition_family)"
    st = "is_stable_or_known::INT"
    filters = {
        "same_family": f"({any_}) AND NOT coalesce(formula = query_formula, false)",
        "adjacent_family": f"ov >= 1 AND NOT same_chemical_system AND ({related} OR fr >= 0.34) AND NOT (same_structure_variant AND same_prototype_family)",
        "boundary_contrast": f"({related} OR ov >= 1) AND NOT symmetry_match AND symmetry_distance IS NOT NULL",
        "wildcard": "true",
        "negative_control": f"ov <= 0 AND NOT ({any_})",
    }
    scores = {
        "same_family": f"4*{s['chemical_system']} + 3.5*{s['prototype_family']} + 2.5*{s['formula_family']} + 2*{s['structure_variant']} + 1.5*{s['material_family']} + 0.75*{s['composition_family']} + 2*fr + 0.75*symmetry_match::INT + 0.5*{st}",
        "adjacent_family": f"3*fr + 2*{s['prototype_family']} + 1.5*{s['formula_family']} + {s['material_family']} + 0.75*{s['composition_family']} + 0.75*{st} + 0.5/(1 + coalesce(symmetry_distance, 50))",
        "boundary_contrast": f"least(symmetry_distance/50, 2) + 1.5*fr + 2*{s['prototype_family']} + 1.5*{s['formula_family']} + 0.75*{s['material_family']} + 0.5*{s['composition_family']} + 0.75*(1-{s['structure_variant']}) + 0.5*{st}",
        "wildcard": f"2*{st} + 0.5*fr + 0.25*(formation_energy IS NOT NULL)::INT + 0.25*(spacegroup_number IS NOT NULL)::INT",
        "negative_control": f"3*(1-fr) + (1-{s['composition_family']}) + (1-{s['material_family']}) + 0.75*(1-{s['formula_family']}) + 0.75*(1-{s['prototype_family']}) + (1-{s['chemical_system']}) + 0.25*{st}",
    }
    missing = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in R.MISSING_CHECKED) + "], lambda x: x IS NOT NULL), ';')"
    ctes = []
    for name in R.POOLS:
        source, condition = "a", filters[name]
        if name == "wildcard":
            source = "(SELECT a.* FROM a ANTI JOIN f3 USING (query_id, candidate_id))"
        if name == "negative_control":
            ctes.append("nb AS MATERIALIZED (SELECT a.* FROM a ANTI JOIN f3 USING (query_id, candidate_id) ANTI JOIN wildcard_p USING (query_id, candidate_id))")
            ctes.append(f"ns AS (SELECT DISTINCT query_id FROM nb WHERE {condition})")
            source, condition = "nb", f"({condition}) OR query_id NOT IN (SELECT query_id FROM ns)"
        seed = CONFIG.seed + R.SEED_OFFSETS[name]
        jitter = f"('0x' || sha256('{seed}:' || candidate_id)[1:12])::BIGINT / 281474976710656.0::DOUBLE"
        order = "selection_score DESC, is_stable_or_known DESC, ov DESC, jit, candidate_id"
        ctes.append(
            f"{name}_p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INT AS rank_in_pool, '{name}' AS pool_name, {missing} AS missing_fields FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(nullif(trim(chemical_system), ''), 'UNKNOWN') ORDER BY {order}) AS sr FROM "
            f"(SELECT *, round(({scores[name]})::DOUBLE, 9) AS selection_score, {jitter} AS jit FROM {source} WHERE {condition})) WHERE sr <= {CONFIG.quotas[name]}) WHERE rank_in_pool <= {CONFIG.sizes[name]})"
        )
        if name == "boundary_contrast":
            ctes.append("f3 AS MATERIALIZED (SELECT DISTINCT query_id, candidate_id FROM (SELECT query_id, candidate_id FROM same_family_p UNION ALL SELECT query_id, candidate_id FROM adjacent_family_p UNION ALL SELECT query_id, candidate_id FROM boundary_contrast_p))")
    ctes.append("p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {n}_p" for n in R.POOLS) + ")")
    return ",\n".join(ctes)


def with_pools() -> str:
    return f"WITH {universe_ctes()},\n{query_ctes()},\n{pool_ctes()}"


def _entropy_ctes() -> str:
    unions = " UNION ALL ".join(f"SELECT query_id, pool_name, '{c}' AS field, {c}::VARCHAR AS value, rank_in_pool FROM p WHERE {c} IS NOT NULL" for c in M.CATEGORIES)
    return f"""vc AS (SELECT query_id, pool_name, field, value, count(*) AS n, min(rank_in_pool) AS fr FROM ({unions}) GROUP BY ALL),
en AS (SELECT query_id, pool_name, field, count(*) AS distinct_values, sum(n)::BIGINT AS total, CASE WHEN count(*) = 1 THEN 0.0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END AS entropy,
   arg_min(value, {{'a': -n, 'b': fr, 'c': value}}) AS dominant_value, max(n) / sum(n) AS dominant_fraction FROM vc GROUP BY ALL)"""


def _mean(*parts: str) -> str:
    return "list_avg(list_filter([" + ", ".join(f"({p})::DOUBLE" for p in parts) + "], lambda x: x IS NOT NULL))"


def metrics_ctes() -> tuple[str, str]:
    """CTEs up to the parts of the metrics, and the SELECT that puts them together."""
    rates = ", ".join(f"avg(same_{c}::INT) AS same_{c}_rate" for c in R.FLAGS)
    wide = ", ".join(
        [f"max(entropy) FILTER (field = '{c}') AS {c}_entropy" for c in M.CATEGORIES] + [f"max(distinct_values) FILTER (field = '{c}') AS {c}_count" for c in M.CATEGORIES] + [f"max(dominant_value) FILTER (field = '{c}') AS {c}_dominant" for c in M.CATEGORIES]
    )
    base = f"""b AS (SELECT query_id, pool_name, count(*) AS n_candidates, count(*) - count(DISTINCT candidate_id) AS duplicate_candidate_count, {rates},
  avg((spacegroup_number = q_spacegroup_number)::INT) AS same_spacegroup_rate, avg((crystal_system_code = q_crystal_system_code)::INT) AS same_crystal_system_rate,
  avg(ov) AS mean_element_overlap_count, avg(fr) AS mean_element_overlap_fraction, avg(symmetry_distance) AS mean_symmetry_distance, median(symmetry_distance) AS median_symmetry_distance,
  avg(selection_score) AS mean_selection_score, median(selection_score) AS median_selection_score, avg(energy_above_hull) AS mean_energy_above_hull, median(energy_above_hull) AS median_energy_above_hull, stddev_samp(energy_above_hull) AS std_energy_above_hull,
  avg((energy_above_hull <= 0.1)::INT) AS stable_fraction, avg((energy_above_hull = 0)::INT) AS on_hull_fraction, avg(known_synthesized::INT) AS known_synthesized_rate, avg(formation_energy) AS mean_formation_energy,
  avg((energy_above_hull IS NULL)::INT) AS energy_above_hull_missing_rate, avg((formation_energy IS NULL)::INT) AS formation_energy_missing_rate FROM p GROUP BY 1, 2),
w AS (SELECT query_id, pool_name, {wide} FROM en GROUP BY 1, 2)"""
    step1 = f"SELECT *, {_mean('same_spacegroup_rate', 'same_crystal_system_rate', '1 - least(greatest(mean_symmetry_distance / 100, 0), 1)')} AS symmetry_similarity_score, {_mean(*[f'same_{n}_rate' for n in R.FLAGS[1:]])} AS family_similarity_score, {_mean('same_chemical_system_rate', 'mean_element_overlap_fraction', 'same_composition_family_rate')} AS chemical_similarity_score FROM b LEFT JOIN w USING (query_id, pool_name)"
    step2 = f"SELECT *, {_mean('same_prototype_family_rate', 'same_structure_variant_rate', 'symmetry_similarity_score')} AS structural_metadata_similarity_score FROM ({step1})"
    ent = lambda ns: _mean(*[f"{n}_entropy" for n in ns])
    step3 = f"SELECT *, {_mean('chemical_similarity_score', 'family_similarity_score', 'structural_metadata_similarity_score', 'stable_fraction')} AS query_similarity_score, {ent(('composition_family', 'material_family', 'formula_family', 'prototype_family', 'structure_variant', 'spacegroup_number', 'crystal_system_code'))} AS pool_diversity_score, {ent(('prototype_family', 'structure_variant', 'spacegroup_number', 'crystal_system_code'))} AS structural_regime_diversity_score FROM ({step2})"
    return f"{with_pools()},\n{_entropy_ctes()},\n{base}", step3


def _metrics_sql() -> str:
    ctes, rows = metrics_ctes()
    skip = ["query_id", "pool_name", "n_candidates", "duplicate_candidate_count", *[f"{c}_count" for c in M.CATEGORIES], *[f"{c}_dominant" for c in M.CATEGORIES]]
    return f"{ctes}\nSELECT {', '.join(skip)}, round(COLUMNS(* EXCLUDE ({', '.join(skip)})), 6) FROM ({rows})"


def _plausibility_ctes() -> str:
    t1, t2, t3 = P.TIERS
    flags = (
        "array_to_string(list_filter([CASE WHEN e IS NULL THEN 'missing_formation_energy' WHEN e > 0 THEN 'positive_formation_energy' END, CASE WHEN h IS NULL THEN 'missing_energy_above_hull' END, CASE WHEN k IS NULL THEN 'missing_known_synthesized_status' END, "
        f"CASE WHEN h IS NULL AND kk THEN 'known_synthesized_no_ehull' END, CASE WHEN h > {t3[0]} THEN '{P.DUBIOUS[2]}' WHEN h > {t2[0]} THEN '{t3[3]}' WHEN h > {t1[0]} THEN '{t2[3]}' END, CASE WHEN kk THEN 'known_synthesized_support' END, "
        "CASE WHEN lab = 'physically_dubious' AND kk THEN 'known_synthesized_overrides_dubious_label_to_warning' END, CASE WHEN NOT k THEN 'no_known_synthesis_support' END], lambda x: x IS NOT NULL), ';')"
    )
    return f"""pl AS MATERIALIZED (SELECT jid, CASE WHEN coalesce(e > 0, false) AND lab2 = 'stable_or_known' AND NOT kk THEN 'metastable_or_uncertain' ELSE lab2 END AS physical_label, round(CASE WHEN e > 0 THEN least(sc, {P.POSITIVE_CAP}) ELSE sc END, 9)::DOUBLE AS physical_score, {flags} AS physical_flags,
   ((e IS NOT NULL)::INT + (h IS NOT NULL)::INT + (k IS NOT NULL)::INT) / 3.0::DOUBLE AS physical_completeness FROM
  (SELECT *, CASE WHEN lab = 'physically_dubious' AND kk THEN 'high_metastability_warning' ELSE lab END AS lab2, CASE WHEN kk THEN least(1.0, s0 + {P.KNOWN_BONUS}) ELSE s0 END AS sc FROM
  (SELECT jid, formation_energy AS e, energy_above_hull AS h, known_synthesized AS k, coalesce(known_synthesized, false) AS kk,
    CASE WHEN energy_above_hull IS NULL THEN CASE WHEN known_synthesized THEN 'stable_or_known' ELSE 'insufficient_data' END WHEN energy_above_hull <= {t1[0]} THEN '{t1[1]}' WHEN energy_above_hull <= {t2[0]} THEN '{t2[1]}' WHEN energy_above_hull <= {t3[0]} THEN '{t3[1]}' ELSE '{P.DUBIOUS[0]}' END AS lab,
    CASE WHEN energy_above_hull IS NULL THEN CASE WHEN known_synthesized THEN {P.KNOWN_ONLY_SCORE} ELSE {P.MISSING_SCORE} END WHEN energy_above_hull <= {t1[0]} THEN {t1[2]} WHEN energy_above_hull <= {t2[0]} THEN {t2[2]} WHEN energy_above_hull <= {t3[0]} THEN {t3[2]} ELSE {P.DUBIOUS[1]} END AS s0 FROM u))),
np AS (SELECT DISTINCT candidate_id, neighbour_id FROM nearest_contextual_neighbours_1c2),
pp AS MATERIALIZED (SELECT candidate_id, neighbour_id, CASE WHEN la = 'physically_dubious' AND lb = 'physically_dubious' THEN 'physically_dubious_pair' WHEN 'physically_dubious' IN (la, lb) THEN 'topology_only_warning' WHEN 'insufficient_data' IN (la, lb) THEN 'insufficient_data'
   WHEN 'high_metastability_warning' IN (la, lb) THEN 'topology_only_warning' WHEN 'metastable_or_uncertain' IN (la, lb) THEN 'plausible_but_uncertain' ELSE 'plausible_pair' END AS pair_label, least(sa, sb) AS pair_score, (ca + cb) / 2 AS pair_completeness FROM
  (SELECT candidate_id, neighbour_id, coalesce(a.physical_label, 'insufficient_data') AS la, coalesce(b.physical_label, 'insufficient_data') AS lb, coalesce(a.physical_score, {P.MISSING_SCORE}::DOUBLE) AS sa, coalesce(b.physical_score, {P.MISSING_SCORE}::DOUBLE) AS sb,
    coalesce(a.physical_completeness, 0) AS ca, coalesce(b.physical_completeness, 0) AS cb FROM np LEFT JOIN pl a ON a.jid = candidate_id LEFT JOIN pl b ON b.jid = neighbour_id))"""


def _stats_ctes() -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, avg({f}::DOUBLE) AS mean, CASE WHEN stddev_pop({f}::DOUBLE) > 1e-12 THEN stddev_pop({f}::DOUBLE) ELSE 1.0 END AS std FROM u" for f in FEATURES)
    long = " UNION ALL ".join(f"SELECT jid, '{f}' AS feature, {f}::DOUBLE AS value FROM u WHERE {f} IS NOT NULL" for f in FEATURES)
    return f"""fs AS MATERIALIZED ({parts}), fl AS MATERIALIZED ({long}),
dl AS MATERIALIZED (SELECT n.candidate_id AS jid_a, n.neighbour_id AS jid_b, a.feature, (b.value - a.value) / fs.std AS delta FROM (SELECT DISTINCT candidate_id, neighbour_id FROM nearest_contextual_neighbours_1c2 WHERE candidate_id != neighbour_id) n
  JOIN fl a ON a.jid = n.candidate_id JOIN fl b ON b.jid = n.neighbour_id AND b.feature = a.feature JOIN fs ON fs.feature = a.feature)"""


def oracle_sql() -> dict[str, str]:
    uni = f"WITH {universe_ctes()}"
    pool = with_pools()
    out = {f"{n}_pool": f"{pool}\nSELECT {', '.join(POOL_OUT)} FROM p WHERE pool_name = '{n}'" for n in R.POOLS}
    out["universe"] = f"{uni} SELECT * EXCLUDE (elements, nonmetal_count), nonmetal_count::DOUBLE AS nonmetal_count, array_to_string(elements, ';') AS elements FROM u"
    out["manifest"] = f"{uni} SELECT dataset_kind, count(*) AS row_count, count(DISTINCT jid) AS distinct_ids FROM u GROUP BY 1"
    out["annotate"] = f"{uni},\n{query_ctes()} SELECT query_id, count(*) AS n, {', '.join(f'sum(same_{c}::INT) AS same_{c}' for c in R.FLAGS)}, sum(ov) AS overlap, sum(symmetry_match::INT) AS symmetry_matches, round(avg(symmetry_distance), 6) AS mean_distance FROM a GROUP BY 1"
    out["pool_metrics"] = _metrics_sql()
    out["pool_entropy"] = f"{pool},\n{_entropy_ctes()} SELECT query_id, pool_name, field, distinct_values, total, round(entropy, 6) AS entropy, dominant_value, round(dominant_fraction, 6) AS dominant_fraction FROM en"
    words = "('', 'unknown', 'unclassified', 'none', 'null', 'nan', 'n/a', 'na', 'not_available', 'not available')"
    unions = " UNION ALL ".join(f"SELECT query_id, pool_name, '{c}' AS field, trim({c}::VARCHAR) AS value FROM p WHERE {c} IS NOT NULL AND lower(trim({c}::VARCHAR)) NOT IN {words}" for c in M.CATEGORIES)
    out["top_categories"] = (
        f"{pool}, vc AS (SELECT query_id, pool_name, field, value, count(*) AS n FROM ({unions}) GROUP BY ALL) SELECT query_id, pool_name, field, value, n, round(n / sum(n) OVER (PARTITION BY query_id, pool_name, field), 6) AS fraction, "
        "row_number() OVER (PARTITION BY query_id, pool_name, field ORDER BY n DESC, value)::INT AS place FROM vc QUALIFY place <= 5"
    )
    present = {c for c in REPORTED if c not in ("n_symmetry_ops",)}
    out["missing_report"] = f"{pool} " + " UNION ALL ".join(f"SELECT query_id, pool_name, '{c}' AS field, {f'count(*) - count({c})' if c in present else 'count(*)'} AS missing_count, round({f'(count(*) - count({c})) / count(*)' if c in present else '1.0'}, 6) AS missing_rate FROM p GROUP BY 1, 2" for c in REPORTED)
    out["pool_overlap"] = f"{pool}, d AS (SELECT DISTINCT query_id, candidate_id, pool_name FROM p) SELECT x.query_id, x.pool_name AS pool_a, y.pool_name AS pool_b, count(*) AS shared FROM d x JOIN d y ON x.query_id = y.query_id AND x.candidate_id = y.candidate_id AND x.pool_name < y.pool_name GROUP BY ALL"
    out["pool_independence"] = f"{pool}, h AS (SELECT query_id, candidate_id, count(*) AS e, count(DISTINCT pool_name) AS k FROM p GROUP BY 1, 2) SELECT query_id, sum(e)::BIGINT AS entries, count(*) AS unique_candidates, sum((k > 1)::INT)::BIGINT AS in_several_pools, round(1 - sum((k > 1)::INT) / sum(e), 6) AS entry_independence, round(1 - sum((k > 1)::INT) / count(*), 6) AS candidate_independence FROM h GROUP BY 1"
    out["top_references"] = f"{pool}, t AS (SELECT query_id, candidate_id, count(DISTINCT pool_name) AS pool_count, count(*) AS occurrences, round(sum(1.0 / rank_in_pool), 9)::DOUBLE AS rw, min(rank_in_pool) AS best_rank FROM p GROUP BY 1, 2) SELECT query_id, candidate_id, pool_count, occurrences, round(rw, 6) AS rank_weight, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY pool_count DESC, occurrences DESC, rw DESC, best_rank, candidate_id)::INT AS place FROM t QUALIFY place <= 15"
    cov = " UNION ALL ".join(f"SELECT query_id, pool_name, '{c}' AS field, count(*) FILTER (lower(trim({c})) NOT IN {words}) AS classified, count(*) - count(*) FILTER (lower(trim({c})) NOT IN {words}) AS \"unknown\", round(count(*) FILTER (lower(trim({c})) NOT IN {words}) / count(*), 6) AS classified_fraction FROM p GROUP BY GROUPING SETS ((query_id, pool_name), (query_id))" for c in ("prototype_family", "structure_variant", "formula_family", "composition_family"))
    out["coverage"] = f"{pool} {cov}"
    out["pool_summary"] = f"{pool} SELECT query_id, pool_name, count(*) AS n, {', '.join(f'count(DISTINCT {c}) AS distinct_{c}' for c in ('chemical_system', 'composition_family', 'material_family', 'formula_family', 'prototype_family'))}, sum(is_stable_or_known::INT)::BIGINT AS stable_count, round(avg(selection_score), 6) AS mean_score, sum((missing_fields != '')::INT)::BIGINT AS rows_with_missing FROM p GROUP BY 1, 2"
    plaus = f"{uni}, {_plausibility_ctes()}"
    out["plausibility_records"] = f"{plaus} SELECT jid, physical_label, round(physical_score, 6) AS physical_score, physical_flags, round(physical_completeness, 6) AS physical_completeness FROM pl"
    out["plausibility_pairs"] = f"{plaus} SELECT candidate_id, neighbour_id, pair_label, round(pair_score, 6) AS pair_score, round(pair_completeness, 6) AS pair_completeness FROM pp WHERE pair_label IN ('plausible_pair', 'plausible_but_uncertain', 'insufficient_data')"
    out["plausibility_summary"] = f"{plaus}, o AS (SELECT *, row_number() OVER (ORDER BY candidate_id, neighbour_id) AS pos FROM pp) SELECT pair_label, count(*) AS n, sum((pos <= 50)::INT)::BIGINT AS n_head, round(avg(pair_score), 6) AS mean_score, round(avg(pair_completeness), 6) AS mean_completeness, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM o GROUP BY 1"
    stats = f"{uni}, {_stats_ctes()}"
    out["feature_stats"] = f"{stats} SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std FROM fs"
    four = ("band_gap", "formation_energy", "density_feature", "spacegroup_number")
    filled = ", ".join(f"coalesce({f}::DOUBLE, (SELECT median({f}) FROM u)) AS {f}" for f in four)
    out["zscore_matrix"] = f"{uni}, i AS MATERIALIZED (SELECT jid, {filled} FROM u) SELECT jid, {', '.join(f'round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 6) AS {f}' for f in four)} FROM i"
    out["pair_deltas"] = f"{stats} SELECT jid_a, jid_b, feature, round(delta, 6) AS delta FROM dl"
    group = "CASE " + " ".join(f"WHEN feature = '{f}' THEN '{U.GROUP_OF[f]}'" for f in FEATURES if f in U.GROUP_OF) + " ELSE 'other' END"
    out["group_deltas"] = f"{stats}, d AS (SELECT jid_a, jid_b, feature, round(delta, 9) AS delta, {group} AS feature_group FROM dl) SELECT jid_a, jid_b, feature_group, count(*) AS feature_count, round(avg(abs(delta)), 6) AS mean_abs_delta, round(max(abs(delta)), 6) AS max_abs_delta, round(avg(delta), 6) AS mean_signed_delta, arg_min(feature, {{'a': -abs(delta), 'b': feature}}) AS dominant_feature FROM d GROUP BY 1, 2, 3"
    out["top_deltas"] = f"{stats}, d AS (SELECT jid_a, jid_b, feature, round(delta, 9) AS delta FROM dl) SELECT jid_a, jid_b, feature, round(delta, 6) AS delta, row_number() OVER (PARTITION BY jid_a, jid_b ORDER BY abs(delta) DESC, feature)::INT AS delta_rank, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'unchanged' END AS direction FROM d WHERE abs(delta) >= 0.1 QUALIFY delta_rank <= 3"
    out["pair_screen"] = f"{stats}, s AS (SELECT jid_a, jid_b, count(*) AS feature_count, avg(abs(delta)) AS mean_delta, max(abs(delta)) AS max_delta, list_avg(list_sort(list(abs(delta)), 'DESC')[1:5]) AS topk_delta FROM dl GROUP BY 1, 2) SELECT jid_a, jid_b, feature_count, round(mean_delta, 6) AS mean_delta, round(max_delta, 6) AS max_delta, round(topk_delta, 6) AS topk_delta, feature_count >= 5 AND mean_delta >= 0.15 AND topk_delta >= 0.25 AND max_delta >= 0.3 AS passes FROM s"
    out["upsert"] = f"{uni}, {query_ctes()} SELECT * FROM (SELECT jid, formula, chemical_system, composition_family, dataset_kind FROM u WHERE jid NOT IN (SELECT jid FROM cp) UNION ALL SELECT jid, formula, chemical_system, composition_family, NULL FROM cp) WHERE jid NOT IN (SELECT jid FROM u WHERE dataset_kind = 'external')"
    return out
