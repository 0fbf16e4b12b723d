"""Casts, null semantics, booleans and text helpers as column expressions.

Several stages of the pipeline treat nulls and unusual words differently; each
variant has its own function and none stands in for another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: texts that stand for nothing
NULL_WORDS = ("nan", "none", "null", "na", "n/a")
UNKNOWN_WORDS = ("", "unknown", "unclassified", "none", "null", "nan", "n/a", "na", "not_available", "not available")
# fixed values: words for yes and no, by stage
SUPPORT_YES = ("true", "t", "yes", "y", "1", "known", "synthesized", "synthesised", "experimental", "experiment")
SUPPORT_NO = ("false", "f", "no", "n", "0", "not_known", "not synthesized", "not_synthesized")
PLAUSIBILITY_NO = ("false", "f", "no", "n", "0", "not_synthesized", "not synthesized")
STRICT_YES = ("true", "t", "yes", "y", "1", "synthesized", "known")
STRICT_NO = ("false", "f", "no", "n", "0", "unknown", "not_synthesized")


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def number(c: Column) -> Column:
    """A finite double; null for null, blank, unparseable, NaN and infinite values."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number_or_null_word(c: Column) -> Column:
    """As :func:`number`; words such as ``n/a`` are null as well."""
    return F.when(~F.lower(_text(c)).isin(*NULL_WORDS), number(c))


def number_keeping_infinity(c: Column) -> Column:
    """A double; null for null, NaN and unparseable values, infinity stays."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or(c: Column, default: float = 0.0) -> Column:
    """A finite or infinite double, ``default`` for null, NaN and unparseable values."""
    return F.coalesce(number_keeping_infinity(c), F.lit(default))


def clip01(c: Column) -> Column:
    """Clamped to 0..1; null and NaN stay null (``least`` and ``greatest`` would skip them)."""
    x = number_keeping_infinity(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def clip01_or_zero(c: Column) -> Column:
    """Clamped to 0..1; null and NaN become 0."""
    return F.coalesce(clip01(c), F.lit(0.0))


def text_or_null(c: Column) -> Column:
    """Trimmed text; null for blank."""
    return F.nullif(_text(c), F.lit(""))


def text_or_empty(c: Column) -> Column:
    """Trimmed text; blank for null."""
    return F.coalesce(_text(c), F.lit(""))


def meaningful_category(c: Column) -> Column:
    """Trimmed text; null for words that say nothing."""
    return F.when(~F.lower(_text(c)).isin(*UNKNOWN_WORDS), _text(c))


def support_flag(c: Column) -> Column:
    """Tri-state boolean of the store: any text that is no word for false or unknown is support."""
    w = F.lower(_text(c))
    return F.when(c.isNull() | w.isin("", *NULL_WORDS, "unknown"), None).when(w.isin(*SUPPORT_NO), False).otherwise(True)


def plausibility_flag(c: Column) -> Column:
    """Tri-state boolean of the plausibility stage: as the store's, with one word less for false."""
    w = F.lower(_text(c))
    return F.when(c.isNull() | w.isin("", *NULL_WORDS, "unknown"), None).when(w.isin(*PLAUSIBILITY_NO), False).otherwise(True)


def strict_flag(c: Column) -> Column:
    """Tri-state boolean of retrieval: unrecognised text is null, ``unknown`` is false."""
    w = F.lower(_text(c))
    return F.when(w.isin(*STRICT_YES), True).when(w.isin(*STRICT_NO), False)


def metric_flag(c: Column) -> Column:
    """Tri-state boolean of the metrics stage: true/1/yes/y, false/0/no/n, else null."""
    w = F.lower(_text(c))
    return F.when(w.isin("true", "1", "yes", "y"), True).when(w.isin("false", "0", "no", "n"), False)


def truthy(c: Column) -> Column:
    """1, true, yes, y and on are true, all else is false."""
    return F.coalesce(F.lower(_text(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def first_number(df: DataFrame, names: Sequence[str]) -> Column:
    """The first number among the columns that exist."""
    found = [number(df[n]) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def first_flag(df: DataFrame, names: Sequence[str]) -> Column:
    """The first tri-state boolean among the columns that exist."""
    found = [support_flag(df[n]) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("boolean")


def first_text(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """The first non-blank text among the columns, whose names may differ in case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    found = [text_or_null(df[by_lower[n.lower()]]) for n in names if n.lower() in by_lower]
    return F.coalesce(*found, F.lit(default).cast("string"))


def at_path(document: Column, *paths: str) -> Column:
    """The first non-null value of a JSON text along dotted paths."""
    return F.coalesce(*[F.get_json_object(document, f"$.{p}") for p in paths])


def missing_names(columns: Sequence[str]) -> Column:
    """Array of the names of the columns that are null in the row."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))


def missing_list(columns: Sequence[str]) -> Column:
    """The same, joined by semicolons."""
    return F.array_join(missing_names(columns), ";")


def completeness(columns: Sequence[str]) -> Column:
    """Share of the columns that are not null in the row."""
    return F.lit(1.0) - F.size(missing_names(columns)) / F.lit(float(max(1, len(columns))))


def slug(c: Column, fallback: str = "case") -> Column:
    """Text fit for a file name."""
    kept = F.regexp_replace(F.regexp_replace(_text(c), r"[^A-Za-z0-9_.=\-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))


def stable_fraction(seed: int | Column, key: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the SHA-256 of ``seed:key``."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.sha2(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def pair_key(a: Column, b: Column) -> Column:
    """The two ids in order, joined by two underscores."""
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def require_columns(df: DataFrame, names: Sequence[str], label: str = "table") -> DataFrame:
    """``df`` itself, or an error that names the absent columns."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{label} lacks the columns {', '.join(absent)}")
    return df


def conform(df: DataFrame, schema: T.StructType, *, keep_others: bool = False) -> DataFrame:
    """``df`` with the columns and types of ``schema``; absent ones are null, bad values become null."""
    cast = [(df[f.name].try_cast(f.dataType) if f.name in df.columns and isinstance(f.dataType, T.AtomicType) else df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    others = [df[c] for c in df.columns if c not in schema.fieldNames()] if keep_others else []
    return df.select(*cast, *others)
