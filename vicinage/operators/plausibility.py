"""Physical plausibility of records and of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.scalars import number_or_null_word, plausibility_flag

# fixed values: tiers of the energy above hull (eV per atom), with label, score and flag
TIERS = ((0.025, "stable_or_known", 0.95, None), (0.100, "metastable_or_uncertain", 0.75, "metastable_energy_above_hull"), (0.200, "high_metastability_warning", 0.55, "high_metastability_energy_above_hull"))
DUBIOUS = ("physically_dubious", 0.25, "high_energy_above_hull")
MISSING_SCORE, KNOWN_ONLY_SCORE, KNOWN_BONUS, POSITIVE_CAP = 0.35, 0.85, 0.25, 0.60
PLAUSIBLE, UNCERTAIN, WARNING, DUBIOUS_PAIR, INSUFFICIENT = "plausible_pair", "plausible_but_uncertain", "topology_only_warning", "physically_dubious_pair", "insufficient_data"


def annotate_records(df: DataFrame, *, formation: str = "formation_energy", hull: str = "energy_above_hull", known: str = "known_synthesized") -> DataFrame:
    """``df`` with ``physical_label``, ``physical_score``, ``physical_flags`` and ``physical_completeness``."""
    e, h, k = number_or_null_word(df[formation]), number_or_null_word(df[hull]), plausibility_flag(df[known])
    is_known = F.coalesce(k, F.lit(False))
    label, score, flag = F.lit(DUBIOUS[0]), F.lit(DUBIOUS[1]), F.lit(DUBIOUS[2])
    for limit, its_label, its_score, its_flag in reversed(TIERS):
        here = h <= limit
        label, score = F.when(here, its_label).otherwise(label), F.when(here, its_score).otherwise(score)
        flag = F.when(here, F.lit(its_flag).cast("string")).otherwise(flag)
    label = F.when(h.isNull() & is_known, "stable_or_known").when(h.isNull(), INSUFFICIENT).otherwise(label)
    score = F.when(h.isNull() & is_known, KNOWN_ONLY_SCORE).when(h.isNull(), MISSING_SCORE).otherwise(score)
    score = F.when(is_known, F.least(F.lit(1.0), score + KNOWN_BONUS)).otherwise(score)
    lifted = is_known & (label == DUBIOUS[0])
    label = F.when(lifted, "high_metastability_warning").otherwise(label)
    positive = F.coalesce(e > 0, F.lit(False))
    score = F.when(positive, F.least(score, F.lit(POSITIVE_CAP))).otherwise(score)
    final = F.when(positive & (label == "stable_or_known") & ~is_known, "metastable_or_uncertain").otherwise(label)
    flags = F.array_compact(
        F.array(
            F.when(e.isNull(), "missing_formation_energy").when(positive, "positive_formation_energy"),
            F.when(h.isNull(), "missing_energy_above_hull"),
            F.when(k.isNull(), "missing_known_synthesized_status"),
            F.when(h.isNull() & is_known, "known_synthesized_no_ehull"),
            F.when(h.isNotNull(), flag),
            F.when(is_known, "known_synthesized_support"),
            F.when(lifted, "known_synthesized_overrides_dubious_label_to_warning"),
            F.when(~F.coalesce(k, F.lit(True)), "no_known_synthesis_support"),
        )
    )
    present = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (e, h, k)), F.lit(0))
    return df.withColumns({"physical_label": final, "physical_score": F.round(score, 9), "physical_flags": flags, "physical_completeness": present / 3.0})


def pair_label(a: Column, b: Column) -> Column:
    """The label of a pair from its records' labels."""
    either = lambda x: (a == x) | (b == x)
    return (
        F.when((a == DUBIOUS[0]) & (b == DUBIOUS[0]), DUBIOUS_PAIR)
        .when(either(DUBIOUS[0]), WARNING)
        .when(either(INSUFFICIENT), INSUFFICIENT)
        .when(either("high_metastability_warning"), WARNING)
        .when(either("metastable_or_uncertain"), UNCERTAIN)
        .otherwise(PLAUSIBLE)
    )


def annotate_pairs(pairs: DataFrame, records: DataFrame, *, a: str, b: str, key: str = "jid") -> DataFrame:
    """``pairs`` with the annotation of both records and of the pair.

    ``records`` are annotated, one row per key; an unknown id counts as
    insufficient data. Rows and their order columns stay as they are.
    """
    parts = ("physical_label", "physical_score", "physical_flags", "physical_completeness")
    out = pairs
    for end, column in (("a", a), ("b", b)):
        side = records.select(F.col(key).alias(f"__k{end}"), *[F.col(p).alias(f"{p}_{end}") for p in parts])
        out = out.join(side, out[column] == F.col(f"__k{end}"), "left").drop(f"__k{end}")
        nothing = F.array(F.lit("missing_formation_energy"), F.lit("missing_energy_above_hull"), F.lit("missing_known_synthesized_status"))
        out = out.withColumns(
            {
                f"physical_label_{end}": F.coalesce(f"physical_label_{end}", F.lit(INSUFFICIENT)),
                f"physical_score_{end}": F.coalesce(f"physical_score_{end}", F.lit(MISSING_SCORE)),
                f"physical_completeness_{end}": F.coalesce(f"physical_completeness_{end}", F.lit(0.0)),
                f"physical_flags_{end}": F.coalesce(f"physical_flags_{end}", nothing),
            }
        )
    label = pair_label(F.col("physical_label_a"), F.col("physical_label_b"))
    extra = F.when(label == WARNING, "structurally_interesting_but_physical_warning").when(label == DUBIOUS_PAIR, "pair_physically_dubious").when(label == INSUFFICIENT, "pair_insufficient_physical_data")
    prefixed = lambda end: F.transform(f"physical_flags_{end}", lambda f: F.concat(F.lit(f"{end}:"), f))
    return out.withColumns(
        {
            "pair_label": label,
            "pair_score": F.least("physical_score_a", "physical_score_b"),
            "pair_completeness": (F.col("physical_completeness_a") + F.col("physical_completeness_b")) / 2,
            "pair_flags": F.array_join(F.array_distinct(F.concat(prefixed("a"), prefixed("b"), F.array_compact(F.array(extra)))), ";"),
        }
    )


def soft_filter(pairs: DataFrame, allowed: Sequence[str] = (PLAUSIBLE, UNCERTAIN, INSUFFICIENT)) -> DataFrame:
    """The pairs with an allowed label."""
    return pairs.filter(F.col("pair_label").isin(*allowed))


def summarise_pairs(pairs: DataFrame, *, order: Sequence[str], head: int = 50, groups: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of pair labels over all pairs and over the first ``head`` of each group."""
    w = Window.partitionBy(*groups).orderBy(*order) if groups else None
    placed = pairs.withColumn("__at", F.row_number().over(w)) if w is not None else pairs.join(pairs.orderBy(*order).limit(head).select(*order, F.lit(1).alias("__at")).distinct(), list(order), "left").withColumn("__at", F.coalesce("__at", F.lit(head + 1)))
    per = placed.groupBy(*groups, "pair_label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("__at") <= head).cast("long")).alias("n_head"), F.avg("pair_score").alias("mean_score"), F.avg("pair_completeness").alias("mean_completeness"))
    total = per.groupBy(*groups).agg(F.sum("n").alias("__t")) if groups else per.agg(F.sum("n").alias("__t"))
    joined = per.join(total, list(groups)) if groups else per.crossJoin(F.broadcast(total))
    return joined.withColumn("fraction", F.col("n") / F.col("__t")).drop("__t")
