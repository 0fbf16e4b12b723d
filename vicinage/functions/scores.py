"""Small numeric combinations that scores are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinage.functions.scalars import clip01, clip01_or_zero


def mean_available(*values: Column) -> Column:
    """Mean of the non-null values; null if there is none."""
    present = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.try_divide(total, F.nullif(present, F.lit(0)))


def mean_clipped(*values: Column) -> Column:
    """Mean of all values clipped to 0..1, of which null counts as 0; of none, 0."""
    return sum((clip01_or_zero(v) for v in values), F.lit(0.0)) / float(max(1, len(values)))


def product_available(*values: Column) -> Column:
    """Product of the clipped non-null values; null if there is none."""
    any_ = F.coalesce(*values).isNotNull()
    product = F.lit(1.0)
    for v in values:
        product = product * F.coalesce(clip01(v), F.lit(1.0))
    return F.when(any_, product)


def weighted_mean(pairs: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of the non-null values, weights renormalised; null if there is none."""
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in pairs if w > 0), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs if w > 0), F.lit(0.0))
    return F.try_divide(total, F.nullif(weight, F.lit(0.0)))


def weighted_score(components: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Clipped components by weight over the sum of all weights; an absent component counts 0."""
    total = sum((clip01_or_zero(components[k]) * w for k, w in weights.items() if k in components), F.lit(0.0))
    return total / float(sum(weights.values()) or 1.0)


def balance_by_ratio(a: Column, b: Column) -> Column:
    """Mean of the two times the ratio of the smaller to the greater; null unless both are given."""
    low, high = F.least(a, b), F.greatest(a, b)
    value = F.when(high <= 0, 0.0).otherwise((a + b) / 2 * F.try_divide(low, F.nullif(high, F.lit(0.0))))
    return F.when(a.isNotNull() & b.isNotNull(), clip01(value))


def balance_by_gap(a: Column, b: Column) -> Column:
    """The smaller times one minus the gap, of clipped values; nulls count 0."""
    x, y = clip01_or_zero(a), clip01_or_zero(b)
    return F.least(x, y) * (F.lit(1.0) - F.abs(x - y))


def closeness(a: Column, b: Column, tolerance: float = 0.35) -> Column:
    """One minus the gap as a share of the tolerance, clipped; null unless both are given."""
    return F.when(a.isNotNull() & b.isNotNull(), clip01(F.lit(1.0) - F.abs(a - b) / tolerance))


def entropy_of(values: Sequence[Column], *, zeros_count: bool) -> Column:
    """Normalised entropy of magnitudes; with ``zeros_count`` null-free zeros widen the scale.

    Nulls and negative values are left out; one value (or none positive) gives 0,
    no value gives null if zeros count and 0 otherwise.
    """
    kept = F.filter(F.array(*values), lambda v: v.isNotNull() & ((v >= 0) if zeros_count else (v > 0)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    share = lambda v: v / F.nullif(total, F.lit(0.0))
    bits = F.aggregate(kept, F.lit(0.0), lambda a, v: a - F.when(v > 0, share(v) * F.log2(share(v))).otherwise(0.0))
    scaled = F.when((F.size(kept) <= 1) | (total <= 0), 0.0).otherwise(bits / F.log2(F.size(kept).cast("double")))
    return F.when(F.size(kept) == 0, None).otherwise(scaled) if zeros_count else scaled


def norm_count(value: Column, target: float) -> Column:
    """Share of a target count, clipped; null counts 0."""
    return clip01_or_zero(value / target)


def band(value: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """The label of the first step (from the top) that ``value`` reaches."""
    out = F.lit(lowest)
    for least, label in reversed(list(steps)):
        out = F.when(value >= least, label).otherwise(out)
    return out


# fixed values: score bands
STRENGTH_STEPS = ((0.85, "very_strong"), (0.70, "strong"), (0.55, "moderate"), (0.35, "weak"))
CONTEXT_STEPS = ((0.85, "very_high"), (0.70, "high"), (0.55, "moderate"), (0.35, "low"))


def strength_band(score: Column, confidence: Column, status: Column) -> Column:
    """Strength of a role; the top band needs a confidence of 0.70. Insufficient
    evidence, unless the score reaches 0.70, and a confidence below 0.45 give none."""
    label = F.when((score >= 0.85) & (confidence < 0.70), "strong").otherwise(band(score, STRENGTH_STEPS, "very_weak"))
    return F.when((status == "insufficient") & (score < 0.70), "insufficient_evidence").when(confidence < 0.45, "insufficient_evidence").otherwise(label)


def plausibility(score: Column, confidence: Column) -> Column:
    return F.when(confidence < 0.45, "insufficient_evidence").when(score >= 0.70, "supported").when(score >= 0.45, "partial").otherwise("not_supported")


def role_confidence(base: Column, score: Column, contradictions: Column, specificity: Column, structural: Column, anchor: Column, gap: Column, missing_rate: Column) -> Column:
    """Confidence of a role from its evidence, its contradictions and the gap to the next role."""
    specific = clip01_or_zero(F.lit(0.35) * specificity + F.lit(0.45) * structural + F.lit(0.20) * anchor)
    agreement = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.10) * contradictions)
    parts = ((0.30, base), (0.25, specific), (0.15, score), (0.15, agreement), (0.10, gap / 0.25), (0.05, F.lit(1.0) - clip01_or_zero(missing_rate)))
    return clip01_or_zero(sum((F.lit(w) * clip01_or_zero(v) for w, v in parts), F.lit(0.0)))


# fixed values: labels too general to say something about structure
GENERIC_LABELS = ("", "none", "null", "nan", "unknown", "generic", "other", "oxide", "chalcogenide", "sulfide", "selenide", "telluride", "intermetallic", "metal", "alloy", "organic", "molecular", "halide")


def label_specificity(formula: Column | None, prototype: Column, variant: Column) -> Column:
    """How specific family labels are: 0.35 formula, 0.45 prototype, 0.20 variant."""
    total = F.lit(0.0)
    for label, weight in ((formula, 0.35), (prototype, 0.45), (variant, 0.20)):
        if label is not None:
            text = F.lower(F.trim(label))
            total = total + F.when(~text.isin(*GENERIC_LABELS) & ~text.startswith("unknown"), weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def context_gate(role: str, label: Column, score: Column, specificity: Column, structural: Column, anchor: Column) -> Column:
    """Support of a role, withheld where its context is generic or weak."""
    if role == "outlier":
        return label
    gated = F.when(specificity < 0.25, "not_supported_due_to_generic_context").when(structural < 0.40, "not_supported_due_to_weak_structural_context").when(anchor < 0.40, "not_supported_due_to_weak_anchor").otherwise(label)
    strong = (score >= 0.70) if role in ("hub", "boundary") else F.lit(False)
    return F.when(label.isin("supported", "partial") & ~strong, gated).otherwise(label)


def profile_confidence(evidence: Column, retrieval: Column, independence: Column, ambiguity: Column, support: Column, contrast: Column) -> Column:
    """Reliability of a profile: evidence .30, retrieval .20, independence .15, clarity .15, measurements .20."""
    measured = (clip01_or_zero(support) + clip01_or_zero(contrast)) / 2
    parts = ((0.30, evidence), (0.20, retrieval), (0.15, independence), (0.15, F.lit(1.0) - clip01_or_zero(ambiguity)), (0.20, measured))
    return clip01_or_zero(sum((F.lit(w) * clip01_or_zero(v) for w, v in parts), F.lit(0.0)))


def contextual_pattern(support: Column, contrast: Column, confidence: Column, status: Column) -> Column:
    """Joint label of support and contrast."""
    s, c = clip01_or_zero(support), clip01_or_zero(contrast)
    return (
        F.when((F.lower(status) == "insufficient") | (clip01_or_zero(confidence) < 0.35), "reliability_limited_context")
        .when((s >= 0.70) & (c >= 0.70), "well_supported_contrast_rich")
        .when((s >= 0.70) & (c < 0.55), "well_supported_low_contrast")
        .when((s < 0.55) & (c >= 0.70), "sparse_contrast_rich")
        .when((s < 0.55) & (c < 0.55), "weakly_contextualised")
        .otherwise("mixed_context")
    )
