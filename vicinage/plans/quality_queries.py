"""Queries of the column profile (p3) and of packed fields (p6), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.operators.column_profile import FieldRule, LoadKeys, profile_issues, profile_loads
from vicinage.operators.packed_fields import split_tables
from vicinage.sources import read_table

POOL_KEYS = LoadKeys("load_id", "pool_name", "load_series", "load_no")
#: fixed values: the reported fields and what their values must look like
POOL_RULES = {
    "candidate_jid": FieldRule(masks="A[A9<>-]+", pattern=r"JVASP-[0-9]+|EXT-[0-9]{8}-[0-9A-F]{10}"),
    "formula": FieldRule(masks="<?A[Aa9<>]*", pattern=r"[A-Z][A-Za-z0-9]*"),
    "chemical_system": FieldRule(masks="<?A[A<>-]*", pattern=r"[A-Z][a-z]?(?:-[A-Z][a-z]?)*", sorted_by="-"),
    "composition_family": FieldRule(distribution=True),
    "prototype_family": FieldRule(),
    "spacegroup_symbol": FieldRule(),
    "stability_label": FieldRule(distribution=True),
    "family_confidence": FieldRule(low=0, high=1),
    "element_overlap_count": FieldRule(low=0),
    "spacegroup_number": FieldRule(low=1, high=230),
    "crystal_system_code": FieldRule(low=1, high=7, distribution=True),
    "symmetry_distance": FieldRule(low=0),
    "energy_above_hull": FieldRule(low=0),
    "selection_score": FieldRule(low=0, high=1),
    "known_synthesized": FieldRule(),
}
#: all columns but those that name a load; the rest has no rules
PROFILE_RULES = POOL_RULES | {name: FieldRule() for name in ("query_jid", "query_formula", "selection_reason", "rank_in_pool", "loaded_at")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every load, pool and field."""
    return profile_issues(read_table(spark, sf_dir, "candidate_pool"), POOL_KEYS, POOL_RULES, read_table(spark, sf_dir, "missing_value_report"))


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality profile of every load, pool and column."""
    return profile_loads(read_table(spark, sf_dir, "candidate_pool"), POOL_KEYS, PROFILE_RULES)


def p3_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profile without the estimated numbers of distinct values: rates, ranges, faults, masks and their divergence."""
    profile = p3_profile(spark, sf_dir).drop("distinct_values")
    return profile.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in profile.dtypes])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields, with its place."""
    clusters, batch = read_table(spark, sf_dir, "cluster_context_explanations_1c2"), read_table(spark, sf_dir, "batch_summary")
    items = split_tables([(clusters, ["record_id"], ["cluster_members"]), (batch, ["record_id"], ["quality_flags", "secondary_descriptors"])])
    return items.select("field", "record_id", "item_no", "item_text").distinct()


def queries() -> dict:
    return {"p3_found": p3_found, "p3_profile": p3_profile, "p3_masks": p3_masks, "p6_found": p6_found}


_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _p3_sql() -> str:
    texts = [f for f in POOL_RULES if f in ("candidate_jid", "formula", "chemical_system", "composition_family", "prototype_family", "spacegroup_symbol", "stability_label")]
    parts = []
    for name, rule in POOL_RULES.items():
        number = "NULL::DOUBLE" if name in (*texts, "known_synthesized") else f"{name}::DOUBLE"
        bounds = [f"{name}::DOUBLE < {rule.low}"] if rule.low is not None else []
        bounds += [f"{name}::DOUBLE > {rule.high}"] if rule.high is not None else []
        if name in texts:
            missing = f"({name} IS NULL OR lower(regexp_replace({name}, '^{_BLANK}+|{_BLANK}+$', '', 'g')) IN ('', 'nan', 'none', 'null', 'n/a'))"
        elif number != "NULL::DOUBLE":
            missing = f"({name} IS NULL OR isnan({name}::DOUBLE))"
        else:
            missing = f"({name} IS NULL)"
        fault = "false"
        if rule.pattern:
            fault = f"NOT regexp_full_match({name}, '{rule.pattern}')"
        if rule.sorted_by:
            fault += f" OR list_sort(list_distinct(string_split({name}, '-'))) != string_split({name}, '-')"
        parts.append(
            f"SELECT load_id, pool_name, load_series, load_no, '{name}' AS field, {missing} AS missing, "
            f"coalesce({' OR '.join(bounds) or 'false'}, false) AS oor, coalesce({fault}, false) AS bad, "
            f"{name + '::VARCHAR' if rule.distribution else 'NULL::VARCHAR'} AS value FROM candidate_pool"
        )
    return f"""
WITH cells AS ({' UNION ALL '.join(parts)}),
t AS (SELECT load_id, pool_name, field, count(*) AS n, sum(missing::INT) AS m, sum((NOT missing AND oor)::INT) AS oor, sum((NOT missing AND bad)::INT) AS bad
      FROM cells GROUP BY ALL),
o AS (SELECT load_id, lag(load_id) OVER (PARTITION BY load_series ORDER BY load_no, load_id) AS before
      FROM (SELECT load_id, max(load_series) AS load_series, max(load_no) AS load_no FROM cells GROUP BY 1) WHERE load_series IS NOT NULL AND load_no IS NOT NULL),
v AS (SELECT load_id, pool_name, field, value, count(*) AS n FROM cells WHERE NOT missing AND value IS NOT NULL GROUP BY ALL),
vt AS (SELECT load_id, pool_name, field, sum(n) AS tot FROM v GROUP BY ALL),
pr AS (SELECT a.load_id, a.pool_name, a.field, o.before, a.tot, b.tot AS tot0 FROM vt a JOIN o USING (load_id) JOIN vt b ON b.load_id = o.before AND b.pool_name = a.pool_name AND b.field = a.field),
w AS (SELECT pr.load_id, pr.pool_name, pr.field, v.value, pr.tot, pr.tot0, v.n * pr.tot0 AS x FROM pr JOIN v USING (load_id, pool_name, field)
      UNION ALL SELECT pr.load_id, pr.pool_name, pr.field, v.value, pr.tot, pr.tot0, -v.n * pr.tot AS x FROM pr JOIN v ON v.load_id = pr.before AND v.pool_name = pr.pool_name AND v.field = pr.field),
g AS (SELECT load_id, pool_name, field, sum(abs(x)) AS gap, max(2 * tot * tot0) AS scale FROM (SELECT load_id, pool_name, field, value, tot, tot0, sum(x) AS x FROM w GROUP BY ALL) GROUP BY 1, 2, 3),
r AS (SELECT load_id, pool_name, field, missing_count, missing_rate FROM missing_value_report
      QUALIFY row_number() OVER (PARTITION BY load_id, pool_name, field ORDER BY reported_at DESC NULLS LAST, missing_count DESC NULLS LAST, missing_rate DESC NULLS LAST) = 1)
SELECT DISTINCT * FROM (
 SELECT load_id, pool_name, field, 'range' AS issue FROM t WHERE oor > 0
 UNION ALL SELECT load_id, pool_name, field, 'format' FROM t WHERE bad > 0
 UNION ALL SELECT a.load_id, a.pool_name, a.field, 'jump' FROM t a JOIN o USING (load_id) JOIN t b ON b.load_id = o.before AND b.pool_name = a.pool_name AND b.field = a.field
   WHERE abs(a.m * b.n - b.m * a.n) * 100 > 20 * a.n * b.n
 UNION ALL SELECT load_id, pool_name, field, 'shift' FROM g WHERE gap * 100 > 35 * scale
 UNION ALL SELECT t.load_id, t.pool_name, t.field, 'report' FROM t JOIN r USING (load_id, pool_name, field)
   WHERE r.missing_count IS NULL OR r.missing_count != t.m OR coalesce(abs(r.missing_rate - t.m / t.n) > 0.001, false))
"""


def _p3_masks_sql() -> str:
    kinds = {f: "text" for f in ("candidate_jid", "formula", "chemical_system", "composition_family", "prototype_family", "spacegroup_symbol", "stability_label", "query_jid", "query_formula", "selection_reason")} | {"known_synthesized": "other", "loaded_at": "other"}
    parts = []
    for name, rule in PROFILE_RULES.items():
        kind = kinds.get(name, "number")
        number = f"{name}::DOUBLE" if kind == "number" else "NULL::DOUBLE"
        bounds = [f"{name}::DOUBLE < {rule.low}"] if rule.low is not None else []
        bounds += [f"{name}::DOUBLE > {rule.high}"] if rule.high is not None else []
        if kind == "text":
            missing = f"({name} IS NULL OR lower(regexp_replace({name}, '^{_BLANK}+|{_BLANK}+$', '', 'g')) IN ('', 'nan', 'none', 'null', 'n/a'))"
        else:
            missing = f"({name} IS NULL OR isnan({name}::DOUBLE))" if kind == "number" else f"({name} IS NULL)"
        fault = "false"
        if rule.pattern:
            fault = f"NOT regexp_full_match({name}, '{rule.pattern}')"
        if rule.sorted_by:
            fault += f" OR list_sort(list_distinct(string_split({name}, '-'))) != string_split({name}, '-')"
        text = name if kind == "text" else f"(CASE WHEN {number} < 0 THEN '-9' ELSE '9' END)"
        parts.append(
            f"SELECT load_id, pool_name, load_series, load_no, '{name}' AS field, {missing} AS missing, coalesce({' OR '.join(bounds) or 'false'}, false) AS oor, coalesce({fault}, false) AS bad, {number} AS number, "
            f"{name if kind == 'text' else 'NULL::VARCHAR'} AS value, {'NULL::VARCHAR' if kind == 'text' else text} AS given FROM candidate_pool"
        )
    runs = "value"
    for what, by in ((r"\p{Lu}\p{L}*", "\x01"), (r"\p{Ll}\p{L}*", "\x02"), (r"\p{Nd}+", "9"), (rf"({_BLANK}){_BLANK}+", r"\1")):
        runs = f"regexp_replace({runs}, '{what}', '{by}', 'g')"
    runs = f"replace(replace({runs}, '\x01', 'A'), '\x02', 'a')"
    return rf"""
WITH RECURSIVE cells AS MATERIALIZED ({' UNION ALL '.join(parts)}),
vals AS MATERIALIZED (SELECT value, {runs} AS m FROM (SELECT DISTINCT value FROM cells WHERE value IS NOT NULL AND NOT missing)),
fold AS (SELECT m, 1 AS i, '' AS done FROM (SELECT DISTINCT m FROM vals) UNION ALL
  SELECT m, CASE WHEN u IS NULL THEN i + 1 ELSE i + u * times END, done || CASE WHEN u IS NULL THEN m[i] ELSE '<' || m[i:i + u - 1] || '>' END FROM
   (SELECT *, len(list_filter(range(1, len(m) + 1), lambda k: u * k <= len(m) - i + 1 AND m[i:i + u * k - 1] = repeat(m[i:i + u - 1], k::BIGINT))) AS times FROM
    (SELECT *, list_min(list_filter([1, 2, 3], lambda k: i + 2 * k - 1 <= len(m) AND m[i:i + k - 1] = m[i + k:i + 2 * k - 1])) AS u FROM fold WHERE i <= len(m)))),
masks AS (SELECT value, done AS mask FROM vals JOIN fold USING (m) WHERE i > len(m)),
c AS MATERIALIZED (SELECT cells.*, CASE WHEN NOT missing THEN coalesce(given, masks.mask) END AS mask FROM cells LEFT JOIN masks USING (value)),
t AS MATERIALIZED (SELECT load_id, pool_name, field, count(*) AS n_rows, sum(missing::INT) AS missing_count, sum((NOT missing AND oor)::INT) AS out_of_range, sum((NOT missing AND bad)::INT) AS bad_format,
  min(number) FILTER (NOT missing) AS low, max(number) FILTER (NOT missing) AS high, min(value) FILTER (NOT missing) AS low_text, max(value) FILTER (NOT missing) AS high_text FROM c GROUP BY ALL),
o AS (SELECT load_id, lag(load_id) OVER (PARTITION BY load_series ORDER BY load_no, load_id) AS before
      FROM (SELECT load_id, max(load_series) AS load_series, max(load_no) AS load_no FROM cells GROUP BY 1) WHERE load_series IS NOT NULL AND load_no IS NOT NULL),
mc AS MATERIALIZED (SELECT load_id, pool_name, field, mask, count(*) AS n FROM c WHERE mask IS NOT NULL GROUP BY ALL),
ra AS (SELECT field, mask, sum(n) / sum(sum(n)) OVER (PARTITION BY field) < 0.01 AS rare FROM mc GROUP BY 1, 2),
dm AS (SELECT load_id, pool_name, field, arg_max(mask, {{'n': n, 'm': mask}}) AS dominant_mask, sum(CASE WHEN rare THEN n ELSE 0 END) AS rare_mask_values FROM mc JOIN ra USING (field, mask) GROUP BY ALL),
mt AS (SELECT load_id, pool_name, field, sum(n) AS tot FROM mc GROUP BY ALL),
pr AS (SELECT a.load_id, a.pool_name, a.field, o.before, a.tot, b.tot AS tot0 FROM mt a JOIN o USING (load_id) JOIN mt b ON b.load_id = o.before AND b.pool_name = a.pool_name AND b.field = a.field),
w AS (SELECT pr.load_id, pr.pool_name, pr.field, mc.mask, pr.tot, pr.tot0, mc.n * pr.tot0 AS x FROM pr JOIN mc USING (load_id, pool_name, field)
      UNION ALL SELECT pr.load_id, pr.pool_name, pr.field, mc.mask, pr.tot, pr.tot0, -mc.n * pr.tot AS x FROM pr JOIN mc ON mc.load_id = pr.before AND mc.pool_name = pr.pool_name AND mc.field = pr.field),
g AS (SELECT load_id, pool_name, field, sum(abs(x)) / max(2 * tot * tot0) AS d FROM (SELECT load_id, pool_name, field, mask, tot, tot0, sum(x) AS x FROM w GROUP BY ALL) GROUP BY 1, 2, 3)
SELECT t.load_id, t.pool_name, t.field, t.n_rows, t.missing_count::BIGINT AS missing_count, round(t.missing_count / t.n_rows, 9) AS missing_rate, round(t.low, 9) AS low, round(t.high, 9) AS high, t.low_text, t.high_text, t.out_of_range::BIGINT AS out_of_range, t.bad_format::BIGINT AS bad_format,
  dominant_mask, coalesce(rare_mask_values, 0)::BIGINT AS rare_mask_values, round(t.missing_count / t.n_rows - b.missing_count / b.n_rows, 9) AS missing_rate_change, round(d, 9) AS mask_divergence
FROM t LEFT JOIN o USING (load_id) LEFT JOIN t b ON b.load_id = o.before AND b.pool_name = t.pool_name AND b.field = t.field LEFT JOIN dm ON dm.load_id = t.load_id AND dm.pool_name = t.pool_name AND dm.field = t.field LEFT JOIN g ON g.load_id = t.load_id AND g.pool_name = t.pool_name AND g.field = t.field
"""


def _p6_sql() -> str:
    quote = '"[^"]*(?:""[^"]*)*"'
    single = "''[^'']*(?:''''[^'']*)*''"
    strip = rf"regexp_replace(%s, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    cells = (
        "SELECT 'cluster_members' AS field, record_id, cluster_members AS cell FROM cluster_context_explanations_1c2 "
        "UNION ALL SELECT 'quality_flags', record_id, quality_flags FROM batch_summary "
        "UNION ALL SELECT 'secondary_descriptors', record_id, secondary_descriptors FROM batch_summary"
    )
    seps = r"|,;/\n\r\t"
    # RE2 has no lookahead: a sentinel separator closes every value, and each match takes its separator along
    token = rf"(?:{_BLANK}*(?:{quote}|{single}){_BLANK}*[{seps}]|[^{seps}]*[{seps}])"
    return rf"""
WITH cells AS (SELECT DISTINCT field, record_id, {strip % 'cell'} AS c FROM ({cells}) WHERE cell IS NOT NULL),
bare AS (SELECT *, regexp_replace(regexp_replace(c, '{quote}', 'q', 'g'), '{single}', 'q', 'g') AS b FROM cells),
inner_ AS (SELECT field, record_id, CASE WHEN regexp_full_match(b, '(?s)\[[^\[\]]*\]') THEN c[2:-2] ELSE c END AS c FROM bare),
toks AS (SELECT field, record_id, c, list_transform(regexp_extract_all(c || '|', '{token}'), lambda x: {strip % 'x[1:-2]'}) AS xs FROM inner_),
vals AS (SELECT DISTINCT field, record_id, c, list_filter(list_transform(xs, lambda x: {strip % ("CASE WHEN regexp_full_match(x, '" + quote + "') THEN replace(x[2:-2], '" + '""' + "', '" + '"' + "') WHEN regexp_full_match(x, '" + single + "') THEN replace(x[2:-2], '''''', '''') ELSE x END")}), lambda x: x != '') AS xs FROM toks)
SELECT DISTINCT field, record_id, i::INT AS item_no, xs[i] AS item_text FROM (SELECT field, record_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM vals)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _p3_sql(), "p3_masks": _p3_masks_sql(), "p6_found": _p6_sql()}
