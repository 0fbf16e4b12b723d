"""Formulas, element sets and family labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: element classes
NONMETALS = ("H", "B", "C", "N", "O", "F", "P", "S", "Cl", "Se", "Br", "I", "Te", "As", "Sb", "Bi")
HALOGENS = ("F", "Cl", "Br", "I")
CHALCOGENS = ("S", "Se", "Te")
# fixed values: last space group number of each crystal system, from triclinic (1) to cubic (7)
CRYSTAL_SYSTEM_ENDS = (2, 15, 74, 142, 167, 194, 230)


def _literal(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def symbols_of_formula(formula: Column) -> Column:
    """Sorted distinct element symbols of a formula."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)"), F.lit(1))))


def symbols_of_system(system: Column) -> Column:
    """Sorted distinct parts of a system such as ``Li-Mn-O``; commas separate as well."""
    parts = F.transform(F.split(F.replace(system, F.lit(","), F.lit("-")), "-"), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def formula_counts(formula: Column) -> Column:
    """Map of element to count; signs of charges at the end, blanks and underscores are dropped, brackets ignored."""
    text = F.regexp_replace(F.regexp_replace(formula.cast("string"), r"[\s_]+", ""), r"\^?[+\-]+$", "")
    token = "([A-Z][a-z]?)([0-9]*[.]?[0-9]*)"
    entries = F.arrays_zip(F.regexp_extract_all(text, F.lit(token), F.lit(1)).alias("e"), F.regexp_extract_all(text, F.lit(token), F.lit(2)).alias("n"))
    amounts = F.transform(entries, lambda x: F.struct(x["e"].alias("e"), F.coalesce(F.nullif(x["n"], F.lit("")).try_cast("double"), F.lit(1.0)).alias("n")))
    symbols = F.array_sort(F.array_distinct(F.transform(amounts, lambda x: x["e"])))
    total = lambda s: F.aggregate(F.filter(amounts, lambda x: x["e"] == s), F.lit(0.0), lambda a, x: a + x["n"])
    return F.map_from_arrays(symbols, F.transform(symbols, total))


def _greatest_divisor(values: Column) -> Column:
    """Greatest common divisor of an array of positive integers, by Euclid's steps on pairs."""

    def pair(a: Column, b: Column) -> Column:
        # 32 steps suffice for numbers below two millions
        steps = F.sequence(F.lit(1), F.lit(32))
        both = F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
        return both["a"]

    return F.aggregate(values, F.lit(0).cast("long"), pair)


def with_ratio(df: DataFrame, counts: str, ratio: str) -> DataFrame:
    """``df`` with ``ratio``: sorted counts divided by their common divisor; null unless all that are positive are integers; others don't count.

    Divisor and counts stand in columns of their own, so that each is made once.
    """
    values = F.filter(F.map_values(F.col(counts)), lambda v: v > 0)
    fits = F.forall(values, lambda v: (F.abs(v - F.round(v)) < 1e-6)) & (F.size(values) > 0)
    whole = F.when(fits, F.array_sort(F.transform(values, lambda v: F.round(v).cast("long"))))
    staged = df.withColumn("__whole", whole)
    staged = staged.withColumn("__divisor", _greatest_divisor(F.col("__whole")))
    return staged.withColumn(ratio, F.transform("__whole", lambda v: F.floor(v / F.col("__divisor")).cast("long"))).drop("__whole", "__divisor")


def anonymous_formula(ratio: Column) -> Column:
    """The ratio with letters in place of elements, such as ``AB2C4``; 1 is left out."""
    parts = F.transform(ratio, lambda n, i: F.concat(F.chr(i + 65), F.when(n == 1, F.lit("")).otherwise(n.cast("string"))))
    return F.when(F.size(ratio) <= 26, F.array_join(parts, ""))


def composition_family(symbols: Column) -> Column:
    """Family of the store: elemental, oxide, halide, chalcogenide, intermetallic or mixed_compound."""
    kept = F.filter(symbols, lambda s: s.isNotNull() & (s != ""))
    metals = F.size(F.filter(kept, lambda s: ~s.isin(*NONMETALS)))
    return (
        F.when(kept.isNull() | (F.size(kept) == 0), None)
        .when(F.size(kept) == 1, "elemental")
        .when(F.array_contains(kept, F.lit("O")), "oxide")
        .when(F.arrays_overlap(kept, _literal(HALOGENS)), "halide")
        .when(F.arrays_overlap(kept, _literal(CHALCOGENS)), "chalcogenide")
        .when((metals >= 2) & (metals == F.size(kept)), "intermetallic")
        .otherwise("mixed_compound")
    )


def external_composition_family(symbols: Column) -> Column:
    """Family of external records; a different set of labels, which never equals the store's."""
    kept = F.filter(symbols, lambda s: s.isNotNull() & (s != ""))
    nonmetals = F.size(F.filter(kept, lambda s: s.isin(*NONMETALS)))
    return (
        F.when(kept.isNull() | (F.size(kept) == 0), "unknown_composition")
        .when((nonmetals > 0) & (nonmetals < F.size(kept)), "mixed_metal_nonmetal")
        .when(nonmetals == 0, "metallic_or_intermetallic")
        .otherwise("nonmetallic")
    )


def metal_count(symbols: Column) -> Column:
    return F.size(F.filter(symbols, lambda s: ~s.isin(*NONMETALS)))


def crystal_system_code(spacegroup: Column) -> Column:
    """1 (triclinic) to 7 (cubic) from the space group number; null outside 1..230."""
    code = F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(CRYSTAL_SYSTEM_ENDS, 1))):
        code = F.when(spacegroup <= end, F.lit(i)).otherwise(code)
    return F.when((spacegroup >= 1) & (spacegroup <= 230), code)


# fixed values: oxide rules by formula family; each line is space group numbers, symbols (lower case, no blanks), variant, confidence
OXIDE_RULES = {
    "ABO3": (
        "perovskite_like",
        0.70,
        "perovskite_like_unknown_variant",
        (
            ((221,), ("pm-3m",), "ideal_cubic_perovskite", 0.82),
            ((62, 63, 74), ("pnma", "pbnm", "cmcm", "imma"), "distorted_perovskite", 0.78),
            ((99, 107, 123, 127, 139, 140, 160, 161), (), "polar_or_tetragonal_perovskite_candidate", 0.72),
        ),
    ),
    "AB2O4": (
        "spinel_like",
        0.70,
        "spinel_like_unknown_variant",
        (
            ((227,), ("fd-3m",), "cubic_spinel", 0.86),
            ((10, 38, 51, 62, 63, 74, 160, 186), ("p2/m", "amm2", "pmma", "pnma", "cmcm", "imma", "r3m", "p63mc", "p6_3mc"), "distorted_spinel_derivative", 0.80),
        ),
    ),
    "A2B2O7": (
        "pyrochlore_like",
        0.72,
        "pyrochlore_like_unknown_variant",
        (
            ((227,), ("fd-3m",), "cubic_pyrochlore", 0.86),
            ((51, 62, 63, 74), ("pmma", "pnma", "pbnm", "cmcm", "imma"), "distorted_pyrochlore_derivative", 0.80),
            ((225, 216), ("fm-3m", "f-43m", "f4-3m"), "defect_fluorite_or_disordered_pyrochlore_candidate", 0.76),
            ((14, 137, 141, 160, 161), (), "low_symmetry_pyrochlore_related_candidate", 0.72),
        ),
    ),
    "AO2": (
        "fluorite_related",
        0.62,
        "fluorite_related_unknown_variant",
        (
            ((225,), ("fm-3m",), "cubic_fluorite", 0.84),
            ((137, 141), ("p42/nmc", "p4_2/nmc", "i41/amd", "i4_1/amd"), "tetragonal_fluorite_derivative", 0.78),
            ((14,), ("p21/c", "p2_1/c"), "monoclinic_fluorite_derivative", 0.80),
            ((227,), ("fd-3m",), "defect_or_ordered_fluorite_related", 0.74),
        ),
    ),
}
FLUORITE_CATIONS = ("Zr", "Hf", "Ce", "Th", "U", "Pu")
KNOWN_SPINELS = ("MgAl2O4", "ZnAl2O4", "Co3O4", "Fe3O4", "LiMn2O4")
MIXED_VALENCE_SPINELS = ("Fe3O4", "Co3O4")
BATTERY_SPINELS = ("LiMn2O4",)
KNOWN_PYROCHLORES = ("Y2Ti2O7", "Gd2Ti2O7", "La2Zr2O7", "Nd2Zr2O7", "Sm2Zr2O7")


LABELS = ("material_family", "formula_family", "prototype_family", "structure_variant", "family_confidence")


def classify_families(
    df: DataFrame,
    *,
    formula: str = "formula",
    composition: str = "composition_family",
    spacegroup: str = "spacegroup_number",
    symbol: str | None = "spacegroup_symbol",
    material: str | None = None,
    prototype: str | None = None,
    into: str = "labels",
) -> DataFrame:
    """``df`` with a struct ``into`` of rule-based labels (:data:`LABELS`).

    Oxide rules go by stoichiometry and symmetry; dichalcogenides and carbides or
    nitrides of three elements by stoichiometry alone. The last rule replaces the
    material family even after an oxide rule. What no rule knows is ``unknown``.
    A given prototype stays and adds confidence. The rules are staged over
    several projections: every intermediate value is made once per row.
    """
    null = F.lit(None).cast("string")
    keep = df.columns
    start = df.select(
        *keep,
        formula_counts(F.col(formula)).alias("__counts"),
        F.regexp_replace(F.coalesce(F.col(formula), F.lit("")), " ", "").alias("__compact"),
        F.col(spacegroup).alias("__sg"),
        (F.lower(F.regexp_replace(F.col(symbol), " ", "")) if symbol else null).alias("__symbol"),
        F.col(composition).alias("__composition"),
        (F.col(material) if material else null).alias("__material"),
        (F.col(prototype) if prototype else null).alias("__prototype"),
    )
    counted = with_ratio(start, "__counts", "__ratio")
    has = lambda e: F.coalesce(F.map_contains_key(F.col("__counts"), e), F.lit(False))
    joined = lambda m: F.array_join(F.array_sort(F.transform(F.map_values(m), lambda v: F.round(v).cast("int"))), ",")
    rest = F.map_filter("__counts", lambda e, _: e != "O")
    told = counted.withColumns(
        {
            "__oxygen": F.when(has("O"), F.round(F.try_element_at("__counts", F.lit("O"))).cast("int")),
            "__rest": joined(rest),
            "__all": joined(F.col("__counts")),
            "__n": F.size("__counts"),
            "__anonymous": anonymous_formula(F.col("__ratio")),
            "__cation": F.coalesce(F.arrays_overlap(F.map_keys("__counts"), _literal(FLUORITE_CATIONS)), F.lit(False)),
            "__oxide": F.coalesce(F.col("__composition") == "oxide", F.lit(False)) | has("O") | F.coalesce(F.col("__material") == "oxide", F.lit(False)),
            "__chalcogen": has("S") | has("Se") | has("Te"),
            "__light": has("C") | has("N"),
        }
    )
    c = F.col
    family_of_formula = (
        F.when((c("__rest") == "1,1") & (c("__oxygen") == 3), "ABO3")
        .when((c("__rest") == "1,2") & (c("__oxygen") == 4), "AB2O4")
        .when((c("__rest") == "3") & (c("__oxygen") == 4) & c("__compact").isin(*MIXED_VALENCE_SPINELS), "AB2O4")
        .when((c("__rest") == "2,2") & (c("__oxygen") == 7), "A2B2O7")
        .when((c("__rest") == "1") & (c("__oxygen") == 2), "AO2")
        .when(c("__anonymous").isNotNull(), c("__anonymous"))
        .when((c("__rest") != "") & (c("__oxygen") > 0), "oxide_formula")
    )
    at_fluorite_site = F.lit(False)
    for numbers, symbols, _, _ in OXIDE_RULES["AO2"][3]:
        at_fluorite_site = at_fluorite_site | F.coalesce(c("__sg").isin(*numbers), F.lit(False)) | F.coalesce(c("__symbol").isin(*symbols), F.lit(False))
    formed = told.withColumn("__formula_family", family_of_formula).withColumn("__site", at_fluorite_site)
    grouped = formed.withColumns(
        {
            "__group": F.when(c("__oxide") & c("__formula_family").isin("ABO3", "AB2O4", "A2B2O7"), c("__formula_family")).when(
                c("__oxide") & c("__formula_family").isin("AO2", "AB2") & (c("__cation") | c("__site")), "AO2"
            ),
            "__layered": F.coalesce(~c("__oxide") & c("__chalcogen") & (c("__all") == "1,2"), F.lit(False)),
            "__max": F.coalesce(c("__light") & (c("__n") == 3) & c("__all").isin("1,2,3", "1,1,2", "1,3,4"), F.lit(False)),
        }
    )
    family, variant, confidence = null, null, F.lit(0.35)
    for name, (label, base, unknown, sites) in OXIDE_RULES.items():
        site_variant, site_confidence = F.lit(unknown), F.lit(0.0)
        for numbers, symbols, its_variant, its_confidence in reversed(sites):
            here = F.coalesce(c("__sg").isin(*numbers), F.lit(False))
            if symbols:
                here = here | F.coalesce(c("__symbol").isin(*symbols), F.lit(False))
            if its_variant == "cubic_spinel":
                its_variant = F.when(c("__compact").isin(*MIXED_VALENCE_SPINELS), "cubic_mixed_valence_or_inverse_spinel").when(c("__compact").isin(*BATTERY_SPINELS), "cubic_battery_spinel").otherwise(its_variant)
            elif its_variant == "distorted_spinel_derivative":
                its_confidence = F.when(c("__compact").isin(*BATTERY_SPINELS), 0.82).otherwise(its_confidence)
                its_variant = F.when(c("__compact").isin(*BATTERY_SPINELS), "distorted_battery_spinel_derivative").otherwise(its_variant)
            site_variant = F.when(here, its_variant).otherwise(site_variant)
            site_confidence = F.when(here, its_confidence).otherwise(site_confidence)
        floor = F.lit(base)
        if name == "AB2O4":
            floor = F.when(c("__compact").isin(*KNOWN_SPINELS), 0.74).otherwise(floor)
        elif name == "A2B2O7":
            floor = F.when(c("__compact").isin(*KNOWN_PYROCHLORES), 0.76).otherwise(floor)
        elif name == "AO2":
            floor = F.when(c("__cation"), 0.70).otherwise(floor)
        family = F.when(c("__group") == name, label).otherwise(family)
        variant = F.when(c("__group") == name, site_variant).otherwise(variant)
        confidence = F.when(c("__group") == name, F.greatest(floor, site_confidence, F.lit(0.35))).otherwise(confidence)
    ruled = grouped.withColumns({"__family": family, "__variant": variant, "__confidence": confidence})
    layered, max_phase = c("__layered"), c("__max")
    raised = F.greatest(c("__confidence"), F.when(layered, 0.62).otherwise(0.0), F.when(max_phase, 0.58).otherwise(0.0))
    final = F.struct(
        F.when(max_phase, "max_phase_like").when(layered, "dichalcogenide_like").otherwise(F.coalesce("__family", "__material", "__composition", F.lit("unknown"))).alias("material_family"),
        F.coalesce(c("__formula_family"), F.when(layered, "AB2"), F.lit("unknown")).alias("formula_family"),
        F.coalesce(c("__prototype"), c("__family"), F.when(layered, "dichalcogenide_like"), F.when(max_phase, "max_phase_like"), F.lit("unknown")).alias("prototype_family"),
        F.coalesce(c("__variant"), F.when(layered, "layered_chalcogenide_candidate"), F.when(max_phase, "layered_carbide_nitride_candidate"), F.lit("unknown")).alias("structure_variant"),
        F.round(F.when(c("__prototype").isNotNull(), F.least(F.lit(0.95), raised + 0.08)).otherwise(raised), 4).alias("family_confidence"),
    )
    return ruled.select(*keep, final.alias(into))
