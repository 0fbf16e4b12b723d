"""Column-level quality profile of loads of a table.

Values are generalised to character-class masks: a run of letters becomes ``A``
or ``a`` (by its first letter), a run of digits ``9``, a run of blanks one blank,
and a repeated unit of masks is folded. A column has few masks, however many
values, so one pass with partial aggregation by (load, column, mask) yields
counts, ranges, format faults, rare masks and the mask distribution at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.session import cut_lineage

_BLANKS = r"[\s\p{Z}\x{0085}\x{FEFF}]"
_NUMERIC = ("double", "float", "decimal", "bigint", "int", "smallint", "tinyint")
MISSING_WORDS = ("nan", "none", "null", "n/a", "")


@dataclass(frozen=True)
class FieldRule:
    """What is known about a column; all parts may be absent.

    ``low``/``high``: bounds of the values. ``masks``: a regular expression for the
    masks that well-formed values have; whatever has another mask is a fault.
    ``pattern``: a regular expression that a value of such a mask must match as a
    whole, for what masks don't tell, such as fixed letters. ``sorted_by``: the value is a list joined by this
    separator whose parts must differ and stand in code-point order.
    ``distribution``: the shares of the stored values are compared between loads.
    """

    low: float | None = None
    high: float | None = None
    masks: str | None = None
    pattern: str | None = None
    sorted_by: str | None = None
    distribution: bool = False


@dataclass(frozen=True)
class LoadKeys:
    """Columns that name a load, its parts and its order."""

    load: str
    part: str
    series: str
    number: str


@dataclass(frozen=True)
class Limits:
    """Thresholds; a change counts when it is greater than the limit.

    Rates are compared as fractions of integers, in hundredths, so that limits
    are met exactly.
    """

    jump_percent: int = 20
    shift_percent: int = 35
    report_rate: float = 0.001
    rare_share: float = 0.01


def value_mask(text: Column) -> Column:
    """The character-class mask of a text."""
    classes = F.mask(text, F.lit("A"), F.lit("a"), F.lit("9"), F.lit(None))
    runs = F.regexp_replace(classes, rf"(?<=[Aa])[Aa]++|(?<=9)9++|(?<={_BLANKS}){_BLANKS}++", "")
    return F.regexp_replace(runs, r"(.{1,3}?)\1++", "<$1>")


def is_missing(column: Column, kind: str) -> Column:
    """Null, NaN, or a text that says so after trimming, in any letter case."""
    if kind in ("double", "float"):
        return column.isNull() | F.isnan(column)
    if kind == "string":
        return column.isNull() | column.rlike(rf"(?i)\A{_BLANKS}*+(?:{'|'.join(MISSING_WORDS)}){_BLANKS}*+\z")
    return column.isNull()


def _format_fault(column: Column, mask: Column, rule: FieldRule) -> Column:
    """The mask decides first; only values of an admitted mask are held against the exact rule."""
    fault = F.lit(False)
    if rule.pattern is not None:
        fault = ~column.rlike(rf"\A(?:{rule.pattern})\z")
    if rule.sorted_by is not None:
        parts = F.split(column, rf"\Q{rule.sorted_by}\E", -1)
        fault = fault | (parts != F.array_sort(F.array_distinct(parts)))
    if rule.masks is not None:
        fault = F.when(~mask.rlike(rf"\A(?:{rule.masks})\z"), F.lit(True)).otherwise(fault)
    return fault


def mask_counts(df: DataFrame, keys: LoadKeys, rules: Mapping[str, FieldRule], *, ranges: bool = True) -> DataFrame:
    """Counts by (load, part, field, mask, value).

    ``value`` is kept only for fields whose distribution is compared, and is null
    for the rest; for missing values mask and value are null. With ``ranges``,
    least and greatest values and numbers of distinct values are added. One
    exchange, after partial aggregation.
    """
    kinds = dict(df.dtypes)
    tests, faults, cells = [], [], []
    for i, (name, rule) in enumerate(rules.items()):
        column, text = df[name], df[name].cast("string")
        number = column.cast("double") if kinds[name].startswith(_NUMERIC) else F.lit(None).cast("double")
        out = F.lit(False)
        if rule.low is not None:
            out = out | (number < rule.low)
        if rule.high is not None:
            out = out | (number > rule.high)
        mask = value_mask(text) if kinds[name] == "string" else F.when(number < 0, F.lit("-9")).otherwise(F.lit("9"))
        # tests stand in columns of their own, so that each is made once
        tests += [
            is_missing(column, kinds[name]).alias(f"__missing{i}"),
            text.alias(f"__text{i}"),
            number.alias(f"__number{i}"),
            mask.alias(f"__mask{i}"),
            F.coalesce(out, F.lit(False)).alias(f"__out{i}"),
        ]
        faults.append(F.coalesce(_format_fault(F.col(f"__text{i}"), F.col(f"__mask{i}"), rule), F.lit(False)).alias(f"__bad{i}"))
        present = ~F.col(f"__missing{i}")
        cell = [
            F.lit(name).alias("field"),
            F.when(present, F.col(f"__mask{i}")).alias("mask"),
            (F.when(present, F.col(f"__text{i}")) if rule.distribution else F.lit(None).cast("string")).alias("value"),
            F.col(f"__missing{i}").cast("long").alias("missing"),
            (present & F.col(f"__out{i}")).cast("long").alias("out_of_range"),
            (present & F.col(f"__bad{i}")).cast("long").alias("bad_format"),
        ]
        if ranges:
            cell += [F.when(present, F.col(f"__number{i}")).alias("number"), F.when(present & F.lit(kinds[name] == "string"), F.col(f"__text{i}")).alias("text"), F.when(present, F.xxhash64(f"__text{i}")).alias("held")]
        cells.append(F.struct(*cell))
    keyed = [df[keys.load].alias("load"), df[keys.part].alias("part"), df[keys.series].alias("series"), df[keys.number].alias("number")]
    long = df.select(*keyed, *tests).select("*", *faults).select("load", "part", "series", "number", F.explode(F.array(*cells)).alias("c"))
    sums = [
        F.max("series").alias("series"),
        F.max("number").alias("load_no"),
        F.count(F.lit(1)).alias("n"),
        F.sum("c.missing").alias("missing"),
        F.sum("c.out_of_range").alias("out_of_range"),
        F.sum("c.bad_format").alias("bad_format"),
    ]
    if ranges:
        sums += [
            F.min("c.number").alias("low"),
            F.max("c.number").alias("high"),
            F.min("c.text").alias("low_text"),
            F.max("c.text").alias("high_text"),
            F.approx_count_distinct("c.held", 0.05).alias("distinct_in_mask"),
        ]
    return long.groupBy("load", "part", "c.field", "c.mask", "c.value").agg(*sums)


def load_order(counts: DataFrame) -> DataFrame:
    """``load``, ``before``: the load with the next lower number of the same series, else null."""
    loads = counts.groupBy("load").agg(F.max("series").alias("series"), F.max("load_no").alias("load_no"))
    named = loads.filter(F.col("load").isNotNull() & F.col("series").isNotNull() & F.col("load_no").isNotNull())
    window = Window.partitionBy("series").orderBy("load_no", "load")
    return named.select("load", F.lag("load").over(window).alias("before")).filter(F.col("before").isNotNull())


def field_totals(counts: DataFrame) -> DataFrame:
    """One row per (load, part, field)."""
    sums = [F.sum(c).alias(c) for c in ("n", "missing", "out_of_range", "bad_format")]
    if "low" in counts.columns:
        sums += [F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text")]
    return counts.groupBy("load", "part", "field").agg(*sums)


def divergence(counts: DataFrame, order: DataFrame, by: str) -> DataFrame:
    """Distance between the distributions of ``by`` (``value`` or ``mask``) in a load and the one before.

    Result: load, part, field, ``gap`` and ``scale``: half the sum of absolute
    differences of shares is ``gap / scale``, both integers. Pairs of which one
    side has no value present are left out, as shares aren't defined there.
    Each load's counts are sent to itself and to its successor and summed with
    opposite signs; no load is joined with all values of another.
    """
    shares = counts.filter(F.col(by).isNotNull()).groupBy("load", "part", "field", F.col(by).alias("key")).agg(F.sum("n").alias("n"))
    total = shares.groupBy("load", "part", "field").agg(F.sum("n").alias("total"))
    pairs = (
        total.join(order, "load")
        .join(total.select(F.col("load").alias("before"), "part", "field", F.col("total").alias("total_before")), ["before", "part", "field"])
        .select("load", "before", "part", "field", "total", "total_before")
    )
    now = shares.join(pairs, ["load", "part", "field"]).select("load", "part", "field", "key", "total", "total_before", (F.col("n") * F.col("total_before")).alias("weight"))
    then = (
        shares.withColumnRenamed("load", "before")
        .join(pairs, ["before", "part", "field"])
        .select("load", "part", "field", "key", "total", "total_before", (-F.col("n") * F.col("total")).alias("weight"))
    )
    by_key = now.unionByName(then).groupBy("load", "part", "field", "key", "total", "total_before").agg(F.sum("weight").alias("weight"))
    return by_key.groupBy("load", "part", "field").agg(
        F.sum(F.abs("weight")).alias("gap"),
        F.max(2 * F.col("total") * F.col("total_before")).alias("scale"),
    )


def profile_loads(df: DataFrame, keys: LoadKeys, rules: Mapping[str, FieldRule], limits: Limits = Limits()) -> DataFrame:
    """One row per (load, part, field): the quality profile.

    Columns: the load and part columns, ``field``, ``n_rows``, ``missing_count``,
    ``missing_rate``, ``distinct_values`` (exact for fields with ``distribution``,
    which have a row per value; else a sketch of 5 % error per mask, summed over
    masks), ``low``/``high`` (numbers) or
    ``low_text``/``high_text`` (texts), ``out_of_range``, ``bad_format``,
    ``dominant_mask``, ``rare_mask_values`` (values whose mask holds less than
    ``rare_share`` of the field over all loads), ``missing_rate_change`` and
    ``mask_divergence`` against the load before (null without one).

    Null loads or parts form groups of their own and have no load before. An
    empty table gives an empty result; other columns are ignored.
    """
    counts = cut_lineage(mask_counts(df, keys, rules))
    order = load_order(counts)
    totals = field_totals(counts)
    overall = counts.filter(F.col("mask").isNotNull()).groupBy("field", "mask").agg(F.sum("n").alias("n_mask"))
    shares = overall.withColumn("share", F.col("n_mask") / F.sum("n_mask").over(Window.partitionBy("field")))
    rare = shares.filter(F.col("share") < limits.rare_share).select("field", "mask", F.lit(True).alias("rare"))
    masks = (
        counts.filter(F.col("mask").isNotNull())
        .groupBy("load", "part", "field", "mask")
        .agg(F.sum("n").alias("n"), F.sum("distinct_in_mask").alias("d"))
        .join(rare, ["field", "mask"], "left")
        .groupBy("load", "part", "field")
        .agg(
            F.max_by("mask", F.struct("n", "mask")).alias("dominant_mask"),
            F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("rare_mask_values"),
            F.sum("d").alias("distinct_values"),
        )
    )
    before = order.join(totals.select(F.col("load").alias("before"), "part", "field", F.col("n").alias("n0"), F.col("missing").alias("m0")), "before").drop("before")
    drift = divergence(counts, order, "mask").select("load", "part", "field", (F.col("gap") / F.col("scale")).alias("mask_divergence"))
    on = ["load", "part", "field"]

    def same(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
        condition = left["load"].eqNullSafe(right["__load"]) & left["part"].eqNullSafe(right["__part"]) & (left["field"] == right["__field"])
        return left.join(right, condition, "left").drop(*[f"__{c}" for c in on])

    full = same(same(same(totals, masks), before), drift)
    return full.select(
        F.col("load").alias(keys.load),
        F.col("part").alias(keys.part),
        "field",
        F.col("n").alias("n_rows"),
        F.col("missing").alias("missing_count"),
        (F.col("missing") / F.col("n")).alias("missing_rate"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        "low",
        "high",
        "low_text",
        "high_text",
        "out_of_range",
        "bad_format",
        "dominant_mask",
        F.coalesce("rare_mask_values", F.lit(0)).alias("rare_mask_values"),
        (F.col("missing") / F.col("n") - F.col("m0") / F.col("n0")).alias("missing_rate_change"),
        "mask_divergence",
    )


def profile_issues(
    df: DataFrame,
    keys: LoadKeys,
    rules: Mapping[str, FieldRule],
    reports: DataFrame | None = None,
    limits: Limits = Limits(),
    report_columns: Sequence[str] = ("field", "missing_count", "missing_rate", "reported_at"),
) -> DataFrame:
    """The faults of the profile: (load, part, ``field``, ``issue``), distinct.

    ``range`` and ``format``: a value present is out of its bounds or form;
    ``jump``: the missing rate differs from the load before by more than the
    limit; ``shift``: so does the distribution of a field marked for it;
    ``report``: the latest report of the part disagrees with the profile (of
    reports with equal times the one with the greatest count, then rate, nulls
    lowest). Nothing is said about parts that a report names but no row has.
    """
    counts = cut_lineage(mask_counts(df, keys, rules, ranges=False))
    order = load_order(counts)
    totals = field_totals(counts)
    on = ["load", "part", "field"]
    direct = totals.select(
        *on,
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("out_of_range") > 0, F.lit("range")), F.when(F.col("bad_format") > 0, F.lit("format")))
            )
        ).alias("issue"),
    )
    before = totals.select(F.col("load").alias("before"), "part", "field", F.col("n").alias("n0"), F.col("missing").alias("m0"))
    jump = (
        totals.join(order, "load")
        .join(before, ["before", "part", "field"])
        .filter(F.abs(F.col("missing") * F.col("n0") - F.col("m0") * F.col("n")) * 100 > limits.jump_percent * F.col("n") * F.col("n0"))
        .select(*on, F.lit("jump").alias("issue"))
    )
    shift = divergence(counts, order, "value").filter(F.col("gap") * 100 > limits.shift_percent * F.col("scale")).select(*on, F.lit("shift").alias("issue"))
    parts = [direct, jump, shift]
    if reports is not None:
        name, count, rate, at = report_columns
        latest = (
            reports.select(reports[keys.load].alias("load"), reports[keys.part].alias("part"), reports[name].alias("field"), reports[count].alias("said"), reports[rate].alias("said_rate"), reports[at].alias("at"))
            .groupBy(*on)
            .agg(F.max(F.struct("at", "said", "said_rate")).alias("r"))
        )
        parts.append(
            totals.join(latest, on)
            .filter(F.col("r.said").isNull() | (F.col("r.said") != F.col("missing")) | F.coalesce(F.abs(F.col("r.said_rate") - F.col("missing") / F.col("n")) > limits.report_rate, F.lit(False)))
            .select(*on, F.lit("report").alias("issue"))
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.distinct().select(F.col("load").alias(keys.load), F.col("part").alias(keys.part), "field", "issue")
