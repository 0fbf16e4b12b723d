"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.contamination import leaked_items, leaked_passages
from vicinage.llm.mixture_clusters import describe_clusters, linked_groups, mixture_clusters
from vicinage.llm.residue import find_residue
from vicinage.llm.set_join import similar_classes, similar_records
from vicinage.llm.source_mix import mix_sources, mixture_shares
from vicinage.llm.top_n import top_n_per_group
from vicinage.llm.varied_subset import coverage, varied_subset
from vicinage.sources import read_table


MEASURES = ("local_context_support", "structural_regime_contrast")


def _divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read_table(spark, sf_dir, "structural_context_batch_summary")
    return mixture_clusters(cases, item="case_id", features=MEASURES, lowest=0.0, highest=1.0)[0]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in clusters of at least eight joined by differences of at most 0.0004.

    The mixture divides the cases; within its clusters, and across their borders,
    links are checked exactly.
    """
    groups = linked_groups(_divided(spark, sf_dir), tolerance=0.0004, least_size=8)
    return groups.select(F.col("item").alias("case_id"), F.col("group_key").alias("cluster_key"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of the mixture with their sizes and representatives."""
    described = describe_clusters(_divided(spark, sf_dir))
    return described.select("cluster_id", "cluster_size", F.col("representative").alias("representative_candidate_id"), "typical_members")


def p1_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every usable case."""
    return _divided(spark, sf_dir).select(F.col("item").alias("case_id"), "cluster_id", "log_density")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every candidate."""
    best = top_n_per_group(
        read_table(spark, sf_dir, "nearest_contextual_neighbours_1c2"),
        "candidate_id",
        "neighbour_id",
        "combined_context_similarity",
        5,
        lowest=0.0,
        highest=1.0,
        drop_self=True,
    )
    return best.select("candidate_id", "neighbour_id", best["rank"].alias("top_rank"))


_BLANK = r"[\s\p{Z}\x{0085}\x{FEFF}]"


def element_symbols(elements: Column) -> Column:
    """Elements without letter case, outer blanks and charge marks; blank ones dropped."""

    def symbol(e: Column) -> Column:
        text = F.regexp_replace(e, f"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")
        text = F.regexp_replace(text, rf"{_BLANK}*+(?:\({_BLANK}*+[ivxIVX0-9]++[+\u2212-]?{_BLANK}*+\)|[0-9]*+[+\u2212-][0-9]*+)$", "")
        return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))

    return F.array_distinct(F.filter(F.transform(elements, symbol), lambda e: e.isNotNull() & (e != "")))


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "material_record")
    return records.select("jid", element_symbols(F.col("elements")).alias("symbols"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of materials of at least six elements whose sets share 0.8 of their union."""
    pairs = similar_records(_materials(spark, sf_dir), record="jid", tokens="symbols", threshold=0.8, least_size=6)
    return pairs.select(F.col("record_a").alias("jid_a"), F.col("record_b").alias("jid_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every material with elements, with its class of equal sets and its number of links."""
    classes = similar_classes(_materials(spark, sf_dir), record="jid", tokens="symbols", threshold=0.8)
    return classes.select(F.col("record").alias("jid"), "class_id", "links")


def _varied(spark: SparkSession, sf_dir: str, size: float) -> DataFrame:
    records = read_table(spark, sf_dir, "material_record")
    # systems from the elements, as chemical_system may be absent or out of order; they pass through the same cleaning
    system = F.nullif(F.array_join(F.array_sort(element_symbols(F.col("elements"))), "-"), F.lit(""))
    family = F.nullif(F.regexp_replace(F.lower(F.trim("composition_family")), r"[\s\-]+", "_"), F.lit(""))
    return varied_subset(records.select("jid", system.alias("system"), family.alias("family")), item="jid", fine="system", coarse="family", size=size)


def p5_varied_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all materials, spread over systems and families."""
    return _varied(spark, sf_dir, 0.1).select("jid", F.col("fine").alias("chemical_system"), F.col("coarse").alias("composition_family"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the subset covers, by family."""
    # a size beyond any table chooses every item
    return coverage(_varied(spark, sf_dir, 0.1), _varied(spark, sf_dir, 2**62))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of a test item."""
    return leaked_items(_passages(spark, sf_dir), exact=12)


def p7_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least twelve words of a test item, single words replaced or not."""
    return _passages(spark, sf_dir).filter("tolerant_words >= 12")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the sources at their target shares."""
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mixture_shares(p8_mixture(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold residue of templates or pages."""
    return find_residue(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with the kinds and the share of their residue."""
    return find_residue(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_clusters": p1_clusters,
        "p1_assignments": p1_assignments,
        "p2_found": p2_found,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p5_varied_subset": p5_varied_subset,
        "p5_coverage": p5_coverage,
        "p7_found": p7_found,
        "p7_tolerant": p7_tolerant,
        "p8_mixture": p8_mixture,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_residue": p9_residue,
    }


P1_SQL = """
WITH RECURSIVE c AS (SELECT case_id, min(local_context_support) AS x, min(structural_regime_contrast) AS y FROM structural_context_batch_summary
  WHERE case_id IS NOT NULL AND local_context_support BETWEEN 0 AND 1 AND structural_regime_contrast BETWEEN 0 AND 1 GROUP BY 1),
e AS MATERIALIZED (SELECT a.case_id AS u, b.case_id AS v FROM c a JOIN c b ON abs(round((a.x - b.x) * 1000000)) <= 400 AND abs(round((a.y - b.y) * 1000000)) <= 400),
r AS (SELECT case_id AS u, case_id AS v FROM c UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS case_id, min(v) AS cluster_key FROM r GROUP BY u HAVING count(*) >= 8
"""
P2_SQL = """
WITH b AS (SELECT candidate_id, neighbour_id, max(combined_context_similarity) AS s FROM nearest_contextual_neighbours_1c2
           WHERE combined_context_similarity BETWEEN 0 AND 1 AND NOT isnan(combined_context_similarity) AND candidate_id != neighbour_id GROUP BY 1, 2)
SELECT candidate_id, neighbour_id, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, neighbour_id)::INT AS top_rank FROM b QUALIFY top_rank <= 5
"""


_SQL_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
P4_SQL = rf"""
WITH e AS (SELECT jid, unnest(elements) AS e FROM material_record),
s AS (SELECT jid, regexp_replace(regexp_replace(e, '^{_SQL_BLANK}+|{_SQL_BLANK}+$', '', 'g'), '{_SQL_BLANK}*(\({_SQL_BLANK}*[ivxIVX0-9]+[+-]?{_SQL_BLANK}*\)|[0-9]*[+-][0-9]*)$', '') AS e FROM e WHERE e IS NOT NULL),
t AS (SELECT DISTINCT jid, upper(e[1]) || lower(e[2:]) AS e FROM s WHERE e != ''),
z AS (SELECT jid, count(*) AS n FROM t GROUP BY jid HAVING count(*) >= 6),
p AS (SELECT a.jid AS jid_a, b.jid AS jid_b, count(*) AS both_n FROM t a JOIN t b USING (e) JOIN z za ON za.jid = a.jid JOIN z zb ON zb.jid = b.jid WHERE a.jid < b.jid GROUP BY 1, 2)
SELECT p.jid_a, p.jid_b FROM p JOIN z za ON za.jid = p.jid_a JOIN z zb ON zb.jid = p.jid_b WHERE both_n * 10 >= 8 * (za.n + zb.n - both_n)
"""
P4_CLASSES_SQL = rf"""
WITH e AS (SELECT jid, row_number() OVER () AS r, elements FROM material_record WHERE jid IS NOT NULL),
x AS (SELECT jid, r, unnest(elements) AS e FROM e),
s AS (SELECT jid, r, regexp_replace(regexp_replace(e, '^{_SQL_BLANK}+|{_SQL_BLANK}+$', '', 'g'), '{_SQL_BLANK}*(\({_SQL_BLANK}*[ivxIVX0-9]+[+-]?{_SQL_BLANK}*\)|[0-9]*[+-][0-9]*)$', '') AS e FROM x WHERE e IS NOT NULL),
t AS (SELECT jid, list_sort(list(DISTINCT upper(e[1]) || lower(e[2:]))) AS ts FROM s WHERE e != '' GROUP BY jid, r),
m AS (SELECT DISTINCT jid, ts FROM t),
d AS MATERIALIZED (SELECT ts, count(*) AS n FROM m GROUP BY ts),
k AS (SELECT ts, unnest(ts) AS e FROM d),
p AS (SELECT a.ts AS x, b.ts AS y, count(*) AS shared FROM k a JOIN k b USING (e) WHERE a.ts != b.ts GROUP BY 1, 2),
l AS (SELECT x AS ts, sum(d.n) AS far FROM p JOIN d ON d.ts = p.y WHERE shared * 10 >= 8 * (len(x) + len(y) - shared) GROUP BY 1)
SELECT m.jid, md5('{{"tokens":["' || array_to_string(m.ts, '","') || '"]}}') AS class_id, (d.n - 1 + coalesce(l.far, 0))::BIGINT AS links FROM m JOIN d USING (ts) LEFT JOIN l USING (ts)
"""
P7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS p FROM w WHERE len(ws) >= 12),
ig AS (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS p FROM i WHERE len(ws) >= 12),
dh AS (SELECT doc_id, array_to_string(ws[p:p + 11], ' ') AS g FROM dg),
ih AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 11], ' ') AS g FROM ig)
SELECT DISTINCT doc_id, item_id FROM dh JOIN ih USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p4_classes": P4_CLASSES_SQL, "p7_found": P7_SQL}
