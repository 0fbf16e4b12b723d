"""Cheap checks of pairs of records: can one be reached from the other, and do they differ enough to matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.chemistry import formula_counts, with_ratio
from vicinage.functions.scalars import clip01
from vicinage.operators.universe import continuity

# fixed values: chemical scores by the closest relation that holds, and the bonus of a shared family
RELATIONS = (("same_reduced_formula", 1.00), ("same_chemical_system", 0.75), ("substantial_element_overlap", 0.45), ("partial_element_overlap", 0.20), ("no_element_overlap", 0.0))
FAMILY_BONUS, CHEMISTRY_SHARE, STRUCTURE_SHARE = 0.20, 0.65, 0.35
#: families between which a step changes the kind of bonding
BONDING_JUMPS = ("halide", "chalcogenide", "oxide")
# fixed values: what a pair must reach to be worth a comparison
GATE = (("too_few_comparable_features", "feature_count", 5), ("low_mean_standardized_delta", "mean_delta", 0.15), ("low_topk_standardized_delta", "topk_delta", 0.25), ("low_max_standardized_delta", "max_delta", 0.30))


def composition_features(df: DataFrame, formula: str = "formula") -> DataFrame:
    """``df`` with ``formula_elements`` (sorted symbols) and ``reduced_key``: the
    reduced composition as text, equal for formulas of equal composition. Both are
    null where the formula holds no element; the key also where counts aren't whole."""
    staged = df.withColumn("__counts", F.map_filter(formula_counts(F.col(formula)), lambda _, n: n > 0))
    staged = with_ratio(staged, "__counts", "__sorted_ratio").drop("__sorted_ratio")
    symbols = F.nullif(F.array_sort(F.map_keys("__counts")), F.array().cast("array<string>"))
    whole = F.forall(F.map_values("__counts"), lambda n: F.abs(n - F.round(n)) < 1e-6)
    staged = staged.withColumn("formula_elements", symbols).withColumn("__n", F.when(whole, F.transform("formula_elements", lambda s: F.round(F.element_at("__counts", s)).cast("long"))))
    staged = staged.withColumn("__d", _divisor(F.col("__n")))
    key = F.array_join(F.transform(F.arrays_zip("formula_elements", "__n"), lambda x: F.concat(x["formula_elements"], (x["__n"] / F.col("__d")).cast("long").cast("string"))), " ")
    return staged.withColumn("reduced_key", key).drop("__counts", "__n", "__d")


def _divisor(values: Column) -> Column:
    from vicinage.functions.chemistry import _greatest_divisor

    return _greatest_divisor(values)


def reachability(pairs: DataFrame, records: DataFrame, *, a: str = "jid_a", b: str = "jid_b", key: str = "jid") -> DataFrame:
    """Reachability of every pair whose two records are known.

    Columns: the ids, ``element_jaccard``, ``same_reduced_formula``,
    ``same_chemical_system``, ``same_family``, ``chemical_score``,
    ``structural_score``, ``reachability_score``, ``hard_reject`` and ``reasons``
    (array). A pair of which a formula can't be read is rejected with scores of 0.
    ``records`` needs formula, composition_family, spacegroup_number,
    crystal_system_code and, if there is one, coord_mean. Two joins by id, whose
    hot ids Spark splits.
    """
    coord = F.col("coord_mean") if "coord_mean" in records.columns else F.lit(None).cast("double")
    known = composition_features(records).select(F.col(key), F.struct("formula_elements", "reduced_key", "composition_family", "spacegroup_number", "crystal_system_code", coord.alias("coord_mean")).alias("r"))
    met = pairs.select(a, b).join(known.select(F.col(key).alias(a), F.col("r").alias("a_")), a).join(known.select(F.col(key).alias(b), F.col("r").alias("b_")), b)
    x, y = F.col("a_"), F.col("b_")
    read = x["formula_elements"].isNotNull() & y["formula_elements"].isNotNull()
    shared = F.size(F.array_intersect(x["formula_elements"], y["formula_elements"]))
    jaccard = F.when(read, shared / F.size(F.array_union(x["formula_elements"], y["formula_elements"]))).otherwise(0.0)
    staged = met.select(
        a,
        b,
        read.alias("read"),
        jaccard.alias("element_jaccard"),
        F.coalesce(read & (x["reduced_key"] == y["reduced_key"]), F.lit(False)).alias("same_reduced_formula"),
        F.coalesce(x["formula_elements"] == y["formula_elements"], F.lit(False)).alias("same_chemical_system"),
        F.coalesce(read & (x["composition_family"] == y["composition_family"]), F.lit(False)).alias("same_family"),
        x["composition_family"].alias("fa"),
        y["composition_family"].alias("fb"),
        F.when(read, continuity("a_", "b_")).otherwise(0.0).alias("structural_score"),
    )
    c = F.col
    relation = F.when(c("same_reduced_formula"), RELATIONS[0][0]).when(c("same_chemical_system"), RELATIONS[1][0]).when(c("element_jaccard") >= 0.5, RELATIONS[2][0]).when(c("element_jaccard") > 0, RELATIONS[3][0]).otherwise(RELATIONS[4][0])
    is_element = lambda f: F.coalesce(c(f) == "elemental", F.lit(False))
    metal = lambda f, g: F.coalesce((c(f) == "intermetallic") & c(g).isin(*BONDING_JUMPS), F.lit(False))
    staged = staged.withColumns({"relation": relation, "up": is_element("fa") & ~is_element("fb"), "down": is_element("fb") & ~is_element("fa"), "jump": metal("fa", "fb") | metal("fb", "fa")})
    score = F.lit(0.0)
    for name, value in RELATIONS:
        score = F.when(c("relation") == name, value).otherwise(score)
    chemical = F.when(c("read"), clip01(score + F.when(c("same_family"), FAMILY_BONUS).otherwise(0.0))).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(~c("read"), F.lit("composition_parse_failure")),
            F.when(c("read"), c("relation")),
            F.when(c("read"), F.when(c("same_family"), F.lit("same_composition_family")).otherwise("different_composition_family")),
            F.when(c("read") & c("up"), F.lit("elemental_to_compound_jump")),
            F.when(c("read") & c("down"), F.lit("compound_to_elemental_jump")),
            F.when(c("read") & c("jump"), F.lit("cross_bonding_regime_jump")),
        )
    )
    reject = ~c("read") | ((c("element_jaccard") == 0) & (~c("same_family") | c("jump"))) | c("up") | c("down")
    out = staged.withColumns({"chemical_score": chemical, "reasons": reasons, "hard_reject": reject})
    total = F.when(c("read"), clip01(CHEMISTRY_SHARE * c("chemical_score") + STRUCTURE_SHARE * c("structural_score"))).otherwise(0.0)
    return out.withColumn("reachability_score", total).select(a, b, "element_jaccard", "same_reduced_formula", "same_chemical_system", "same_family", "chemical_score", "structural_score", "reachability_score", "hard_reject", "reasons")


def precheck(reached: DataFrame, screened: DataFrame, *, a: str = "jid_a", b: str = "jid_b") -> DataFrame:
    """Which pairs are worth a comparison: ``passes``, ``too_alike`` and ``reasons``.

    ``reached`` comes from :func:`reachability`, ``screened`` (feature_count,
    mean_delta, topk_delta, max_delta) from :func:`vicinage.operators.universe.pair_screen`;
    a pair without a comparable feature counts 0 in all of them.
    """
    measures = [m for _, m, _ in GATE]
    both = reached.select(a, b, "hard_reject", "reachability_score").join(screened.select(a, b, *measures), [a, b], "left").fillna(0, measures)
    short = [F.when(F.col(m) < least, F.lit(name)) for name, m, least in GATE]
    staged = both.withColumn("short", F.array_compact(F.array(*short)))
    reasons = F.concat(F.when(F.col("hard_reject"), F.array(F.lit("reachability_hard_reject"))).otherwise(F.array().cast("array<string>")), "short")
    return staged.select(a, b, "reachability_score", (F.size("short") > 0).alias("too_alike"), (~F.col("hard_reject") & (F.size("short") == 0)).alias("passes"), reasons.alias("reasons"))
