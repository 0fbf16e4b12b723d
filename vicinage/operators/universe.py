"""The reference universe: union, deduplication, overlays, features and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions import chemistry as C
from vicinage.operators.ranks import medians
from vicinage.functions.scalars import first_flag, first_number, stable_fraction, support_flag, text_or_null

# fixed values: feature groups, and names under which optional physical fields may arrive
FEATURE_GROUPS = {
    "dimensional": ("c_over_a", "c_over_b", "max_axis_over_min_axis", "frac_z_span", "cart_z_span_over_c"),
    "bonding": ("bond_mean_en_diff", "bond_std_en_diff", "bond_max_en_diff", "bond_length_mean", "bond_length_std", "bond_length_range", "frac_short_bonds", "ionicity_proxy_comp"),
    "coordination": ("coord_mean", "coord_std", "frac_low_coord_sites", "frac_high_coord_sites"),
    "composition": ("n_elements", "metal_count", "nonmetal_count", "mean_electronegativity", "electronegativity_range", "atomic_radius_mean", "valence_electrons_mean"),
    "property_proxy": ("band_gap", "formation_energy", "density_feature", "exfoliation_energy_feature"),
}
GROUP_OF = {f: g for g, fs in FEATURE_GROUPS.items() for f in fs}
ALIASES = {
    "band_gap": ("band_gap", "optb88vdw_bandgap"),
    "formation_energy": ("formation_energy", "formation_energy_peratom"),
    "density_feature": ("density_feature", "density"),
    "exfoliation_energy_feature": ("exfoliation_energy_feature", "exfoliation_energy"),
    "energy_above_hull": ("energy_above_hull", "ehull", "e_above_hull"),
    "spacegroup_number": ("spacegroup_number", "spg_number"),
}
KNOWN_ALIASES = ("known_synthesized", "is_synthesized", "icsd")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which should end in a unique column."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def union_universe(parts: Sequence[DataFrame], key: str = "jid", first_by: Sequence[str] = ()) -> DataFrame:
    """The union of corpora; of equal ids, the row of the earlier corpus stays.

    Within one corpus the first row by ``first_by`` and then by all columns stays
    (nulls first), so that the choice doesn't depend on row order.
    """
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in ("__part", key, *first_by)]
    return keep_first(both, [key], [F.col(c).asc_nulls_first() for c in ("__part", *first_by, *rest)]).drop("__part")


def known_overlay(df: DataFrame, known: DataFrame, *, key: str = "jid", status: str = "known_synthesized") -> DataFrame:
    """``df`` with the tri-state ``status`` of ``known`` laid over its own.

    ``known`` has one row per key (see :func:`last_status`); its null leaves the
    row's value. The sides are joined by exchange or broadcast as sizes allow.
    """
    own = first_flag(df, [status, *KNOWN_ALIASES])
    side = known.select(F.col(key).alias("__k"), support_flag(F.col(status)).alias("__s"))
    joined = df.withColumn("__own", own).join(side, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(status, F.coalesce("__s", "__own")).drop("__k", "__s", "__own")


def last_status(df: DataFrame, *, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """Of a list of statuses the last of each key by ``order``; equal places by the greater status."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(status, F.struct(*order, status)).alias(status))


def prepare(df: DataFrame, *, key: str = "jid", keep: Sequence[str] = ()) -> DataFrame:
    """Features of the universe: cleaned elements, systems, families and numbers.

    Elements come from the ``elements`` array if it holds any, else from the
    formula. Absent columns become nulls; the columns in ``keep`` stay.
    """
    text = lambda n: text_or_null(df[n]) if n in df.columns else F.lit(None).cast("string")
    formula = F.coalesce(text("reduced_formula"), text("formula"))
    given = df["elements"].cast("array<string>") if "elements" in df.columns else F.lit(None).cast("array<string>")
    letters = lambda e: F.initcap(F.regexp_extract(F.trim(F.replace(e, F.lit(" "), F.lit(" "))), r"^([A-Za-z]{1,2})(?![A-Za-z])", 1))
    cleaned = F.array_sort(F.array_distinct(F.filter(F.transform(F.array_compact(given), letters), lambda s: s != "")))
    symbols = F.when(F.size(cleaned) > 0, cleaned).otherwise(C.symbols_of_formula(formula))
    number = lambda n: first_number(df, ALIASES.get(n, (n,)))
    base = df.select(
        df[key].cast("string").alias("jid"),
        formula.alias("formula"),
        text("material_type").alias("material_type"),
        text("dataset_kind").alias("dataset_kind"),
        F.coalesce(symbols, F.array().cast("array<string>")).alias("elements"),
        text("spacegroup_symbol").alias("spacegroup_symbol"),
        number("spacegroup_number").cast("int").alias("spacegroup_number"),
        number("formation_energy").alias("formation_energy"),
        number("band_gap").alias("band_gap"),
        number("density_feature").alias("density_feature"),
        number("energy_above_hull").alias("energy_above_hull"),
        first_flag(df, KNOWN_ALIASES).alias("known_synthesized"),
        *[df[c] for c in keep],
    )
    return base.select(
        "*",
        F.nullif(F.array_join("elements", "-"), F.lit("")).alias("chemical_system"),
        C.composition_family(F.col("elements")).alias("composition_family"),
        C.crystal_system_code(F.col("spacegroup_number")).alias("crystal_system_code"),
        F.size("elements").cast("double").alias("n_elements"),
        C.metal_count(F.col("elements")).cast("double").alias("metal_count"),
        (F.size("elements") - C.metal_count(F.col("elements"))).cast("double").alias("nonmetal_count"),
    )


def with_families(universe: DataFrame) -> DataFrame:
    """Rule-based family labels; the material family stays the composition family where that is given."""
    labelled = C.classify_families(universe, material="composition_family", into="__f")
    return labelled.select(
        *universe.columns,
        F.coalesce("composition_family", F.col("__f.material_family")).alias("material_family"),
        *[F.col(f"__f.{n}").alias(n) for n in C.LABELS[1:]],
        F.col("__f.material_family").alias("classified_family"),
    )


def upsert(universe: DataFrame, records: DataFrame, *, key: str = "jid", overwrite: bool = True) -> DataFrame:
    """``universe`` with ``records`` put in; records with a known key replace it, or are left out."""
    if overwrite:
        return universe.join(records.select(key).distinct(), key, "left_anti").unionByName(records, allowMissingColumns=True)
    return universe.unionByName(records.join(universe.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def remove(universe: DataFrame, ids: DataFrame, *, key: str = "jid") -> DataFrame:
    return universe.join(ids.select(key).distinct(), key, "left_anti")


def resolve(universe: DataFrame, ids: DataFrame, *, key: str = "jid", strict: bool = True) -> DataFrame:
    """The records of the given ids; with ``strict`` an id without a record is an error that names some."""
    wanted = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    if strict:
        # a few names for the message
        absent = [r[key] for r in wanted.join(universe.select(key), key, "left_anti").limit(5).collect()]
        if absent:
            raise KeyError(f"no record for {absent}")
    return universe.join(wanted, key, "left_semi")


def resolve_external(universe: DataFrame, ids: DataFrame, *, key: str = "jid", strict: bool = True) -> DataFrame:
    """:func:`resolve` among the external records."""
    return resolve(universe.filter(F.col("dataset_kind") == "external"), ids, key=key, strict=strict)


PHYSICAL = ("formula", "formation_energy", "energy_above_hull", "known_synthesized", "dataset_kind", "material_type")
PROFILE = ("formula", "material_type", "dataset_kind", "chemical_system", "composition_family", "n_elements", "elements", "formula_family", "prototype_family", "structure_variant", "material_family", "spacegroup_number", "spacegroup_symbol", "crystal_system_code", "formation_energy", "energy_above_hull", "known_synthesized", "band_gap", "density_feature", "metal_count", "nonmetal_count")


def physical_properties(records: DataFrame, *, key: str = "jid") -> DataFrame:
    """What plausibility is judged by; NaN is null."""
    return records.select(key, *[_finite(records, c).alias(c) for c in PHYSICAL])


def profile_rows(records: DataFrame, *, key: str = "jid") -> DataFrame:
    """One flat profile row per record: identity, chemistry, symmetry, stability and features, and how many are there."""
    fields = [c for c in PROFILE if c in records.columns]
    present = sum((F.when(_finite(records, c).isNotNull(), 1).otherwise(0) for c in fields), F.lit(0))
    return records.select(key, *[_finite(records, c).alias(c) for c in fields], (present / len(fields)).alias("completeness"))


def standard_vector(df: DataFrame, stats: DataFrame, features: Sequence[str], *, key: str = "jid") -> DataFrame:
    """``vector``: the features in order, in deviations from the mean; null where a value is missing."""
    moments = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("m"))
    # one row with one entry per feature
    rows = df.join(F.broadcast(moments))
    parts = [(_finite(df, f).cast("double") - F.element_at("m", F.lit(f))["mean"]) / F.element_at("m", F.lit(f))["std"] for f in features]
    return rows.select(key, F.array(*parts).alias("vector"))


def _finite(df: DataFrame, name: str) -> Column:
    column = df[name]
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column) if dict(df.dtypes)[name] in ("double", "float") else column


def sort_by_id(df: DataFrame, *, key: str = "jid") -> DataFrame:
    """Rows in the order of the id as text, so that ``JVASP-10`` stands before ``JVASP-9``."""
    return df.orderBy(F.col(key).cast("string"))


def sort_by_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ordered by those of ``columns`` that exist; as they are if there is none."""
    there = [c for c in columns if c in df.columns]
    return df.orderBy(*there) if there else df


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean and population deviation of finite values; a deviation of nearly 0 becomes 1. One pass."""
    fine = {f: F.when(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f).cast("double")) for f in features}
    row = df.agg(*[x for f in features for x in (F.count(fine[f]).alias(f"n_{f}"), F.avg(fine[f]).alias(f"m_{f}"), F.stddev_pop(fine[f]).alias(f"s_{f}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std")) for f in features])).alias("x")).select(
        "x.feature", "x.n", "x.mean", F.when(F.col("x.std") > 1e-12, F.col("x.std")).otherwise(1.0).alias("std")
    )


def feature_matrix(df: DataFrame, features: Sequence[str], *, key: str = "jid") -> DataFrame:
    """Median-imputed, standardised features; a feature without any value is 0.

    The medians are exact; means and population deviations are of the imputed values.
    """
    fine = {f: F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f)) < float("inf")), F.col(f).cast("double")) for f in features}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), fine[f].alias("value")) for f in features])).alias("x")).select("x.feature", "x.value")
    found = medians(long, "feature", "value").groupBy().agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("median"))), F.lit(0.0)).alias(f"__med_{f}") for f in features])
    # one row of medians
    filled = df.join(F.broadcast(found)).select(key, *[F.coalesce(fine[f], F.col(f"__med_{f}")).alias(f) for f in features])
    moments = filled.agg(*[x for f in features for x in (F.avg(f).alias(f"__m_{f}"), F.stddev_pop(f).alias(f"__s_{f}"))])
    return filled.join(F.broadcast(moments)).select(key, *[((F.col(f) - F.col(f"__m_{f}")) / F.when(F.col(f"__s_{f}") > 1e-12, F.col(f"__s_{f}")).otherwise(1.0)).alias(f) for f in features])


def signed_deltas(pairs: DataFrame, universe: DataFrame, stats: DataFrame, features: Sequence[str], *, a: str = "jid_a", b: str = "jid_b") -> DataFrame:
    """Long table of ``(b - a) / std`` per pair and feature; features without both values are absent."""
    long = universe.select(F.col("jid"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("jid", "x.feature", "x.value")
    left = long.select(F.col("jid").alias(a), "feature", F.col("value").alias("va"))
    right = long.select(F.col("jid").alias(b), "feature", F.col("value").alias("vb"))
    joined = pairs.select(a, b).join(left, a).join(right, [b, "feature"]).join(F.broadcast(stats.select("feature", "std")), "feature")
    return joined.filter(F.col("va").isNotNull() & F.col("vb").isNotNull() & ~F.isnan("va") & ~F.isnan("vb")).select(a, b, "feature", ((F.col("vb") - F.col("va")) / F.col("std")).alias("delta"))


def grouped_deltas(deltas: DataFrame, *, keys: Sequence[str] = ("jid_a", "jid_b")) -> DataFrame:
    """Per pair and feature group: count, mean and greatest magnitude, signed mean and the dominant feature.

    Of equal magnitudes the feature whose name is smaller dominates.
    """
    group = F.create_map(*[F.lit(x) for f, g in GROUP_OF.items() for x in (f, g)])
    tagged = deltas.withColumn("feature_group", F.coalesce(F.try_element_at(group, F.col("feature")), F.lit("other"))).withColumn("size", F.abs("delta"))
    return tagged.groupBy(*keys, "feature_group").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.avg("size").alias("mean_abs_delta"),
        F.max("size").alias("max_abs_delta"),
        F.avg("delta").alias("mean_signed_delta"),
        F.min_by("feature", F.struct(-F.col("size"), F.col("feature"))).alias("dominant_feature"),
    )


def top_deltas(deltas: DataFrame, n: int = 8, *, least: float = 0.0, keys: Sequence[str] = ("jid_a", "jid_b")) -> DataFrame:
    """The ``n`` features of greatest magnitude per pair, with their direction."""
    w = Window.partitionBy(*keys).orderBy(F.abs("delta").desc(), F.col("feature"))
    ranked = deltas.filter(F.abs("delta") >= least).withColumn("delta_rank", F.row_number().over(w)).filter(F.col("delta_rank") <= n)
    return ranked.withColumn("direction", F.when(F.col("delta") > 0, "increase").when(F.col("delta") < 0, "decrease").otherwise("unchanged"))


def pair_screen(deltas: DataFrame, *, top: int = 5, keys: Sequence[str] = ("jid_a", "jid_b")) -> DataFrame:
    """Per pair: count, mean, greatest and mean of the ``top`` magnitudes, and whether the pair passes the gate."""
    sizes = F.sort_array(F.collect_list(F.abs("delta")), asc=False)
    per = deltas.groupBy(*keys).agg(F.count(F.lit(1)).alias("feature_count"), F.avg(F.abs("delta")).alias("mean_delta"), F.max(F.abs("delta")).alias("max_delta"), F.slice(sizes, 1, top).alias("__top"))
    mean_top = F.aggregate("__top", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("__top"), F.lit(1))
    scored = per.withColumn("topk_delta", mean_top).drop("__top")
    gate = (F.col("feature_count") >= 5) & (F.col("mean_delta") >= 0.15) & (F.col("topk_delta") >= 0.25) & (F.col("max_delta") >= 0.30)
    return scored.withColumn("passes", gate)


def continuity(a: str = "a", b: str = "b") -> Column:
    """Structural continuity of two records given as structs with space group, crystal system and coordination."""
    gap = F.abs(F.col(f"{a}.spacegroup_number") - F.col(f"{b}.spacegroup_number"))
    coord = F.abs(F.col(f"{a}.coord_mean") - F.col(f"{b}.coord_mean"))
    return (
        F.when(gap <= 20, 0.35).when(gap <= 80, 0.15).otherwise(0.0)
        + F.when(F.col(f"{a}.crystal_system_code") == F.col(f"{b}.crystal_system_code"), 0.20).otherwise(0.0)
        + F.when(coord <= 1.5, 0.30).when(coord <= 3.0, 0.15).otherwise(0.0)
    )


def sample_strata(df: DataFrame, strata: Sequence[tuple[str, Column, int]], *, seed: int, key: str = "jid") -> DataFrame:
    """A seeded sample of given size of each (possibly overlapping) stratum, without repeats.

    Ranks follow a hash of seed, stratum and key; a row in several strata is
    drawn for each and kept once.
    """
    picked = []
    for name, condition, n in strata:
        rows = df.filter(condition).withColumn("__h", stable_fraction(F.lit(f"{seed}:{name}"), F.col(key)))
        # the limit is the sample size; the ordered limit keeps n rows per task before one merge
        picked.append(rows.orderBy("__h", key).limit(n).drop("__h"))
    return reduce(DataFrame.unionByName, picked).dropDuplicates([key])


def manifest(universe: DataFrame) -> DataFrame:
    """Rows and distinct ids by corpus kind."""
    return universe.groupBy("dataset_kind").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("jid").alias("distinct_ids"))
