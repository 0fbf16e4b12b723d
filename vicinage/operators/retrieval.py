"""Ranked reference pools for many query entities in one job.

The universe meets all queries of a block once, in a broadcast join with a stated,
size-checked query table. That pass yields narrow entries (query, pool, candidate,
score), which two ranks (within a system, then within the pool) cut before their
exchanges; only what is chosen is joined with the full rows again. Queries beyond
the limit are worked off in blocks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.scalars import stable_fraction, strict_flag, text_or_null
from vicinage.session import cut_lineage

POOLS = ("same_family", "adjacent_family", "boundary_contrast", "wildcard", "negative_control")
FLAGS = ("chemical_system", "composition_family", "material_family", "formula_family", "prototype_family", "structure_variant")
MISSING_CHECKED = (*FLAGS, "spacegroup_number", "crystal_system_code", "formation_energy", "energy_above_hull", "known_synthesized")


@dataclass(frozen=True)
class PoolConfig:
    """Sizes, quotas per chemical system (0: none), thresholds and seed."""

    sizes: Mapping[str, int] = field(default_factory=lambda: {"same_family": 500, "adjacent_family": 500, "boundary_contrast": 500, "wildcard": 100, "negative_control": 100})
    quotas: Mapping[str, int] = field(default_factory=lambda: {"same_family": 50, "adjacent_family": 25, "boundary_contrast": 25, "wildcard": 10, "negative_control": 10})
    seed: int = 451
    stable_hull: float = 0.10
    adjacent_least_overlap: int = 1
    control_most_overlap: int = 0
    queries_per_block: int = 5_000

    def with_sizes(self, **sizes: int) -> PoolConfig:
        return replace(self, sizes={**self.sizes, **sizes})


def query_rows(universe: DataFrame, *, family: str = "classified_family") -> DataFrame:
    """Query columns (prefixed ``q_``) from rows prepared like a universe.

    A query's material family is the classifier's, a candidate's its composition family.
    """
    material = F.coalesce(F.col(family), F.col("material_family")) if family in universe.columns else F.col("material_family")
    return universe.select(
        F.col("jid").alias("query_id"),
        F.col("formula").alias("query_formula"),
        F.col("elements").alias("q_elements"),
        *[text_or_null(F.col(c)).alias(f"q_{c}") for c in FLAGS if c != "material_family"],
        text_or_null(material).alias("q_material_family"),
        F.col("spacegroup_number").alias("q_spacegroup_number"),
        F.col("crystal_system_code").alias("q_crystal_system_code"),
    )


def annotate(universe: DataFrame, queries: DataFrame, config: PoolConfig = PoolConfig()) -> DataFrame:
    """Every candidate against every query: overlaps, flags, symmetry and stability.

    A flag is false where the query's value is null. Symmetry goes by space group,
    or by crystal system if the query has no space group. ``queries`` must not
    exceed ``queries_per_block`` rows (checked); see :func:`in_blocks`.
    """
    return flags(_meet(universe, queries, config))


def _meet(universe: DataFrame, queries: DataFrame, config: PoolConfig) -> DataFrame:
    n = queries.limit(config.queries_per_block + 1).count()
    if n > config.queries_per_block:
        raise ValueError(f"more than {config.queries_per_block} queries in a block")
    # every universe row meets all queries of the block, so the work is spread before the rows multiply
    spread = universe.repartition(int(universe.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = candidates(spread, config).crossJoin(F.broadcast(queries))
    return both.filter(F.col("candidate_id") != F.col("query_id"))


def candidates(universe: DataFrame, config: PoolConfig) -> DataFrame:
    """Universe rows as candidates: ``candidate_id``, ``known_flag`` and ``is_stable_or_known``."""
    known = strict_flag(F.col("known_synthesized"))
    stable = F.coalesce(F.col("energy_above_hull") <= config.stable_hull, F.lit(False)) | F.coalesce(known, F.lit(False))
    return universe.withColumn("known_flag", known).withColumn("is_stable_or_known", stable).withColumnRenamed("jid", "candidate_id")


def flags(both: DataFrame) -> DataFrame:
    """Overlaps, flags and symmetry of rows that hold a candidate and a query."""
    overlap = F.size(F.array_intersect("elements", "q_elements"))
    by_group = F.col("q_spacegroup_number").isNotNull()
    distance = F.when(by_group, F.abs(F.col("spacegroup_number") - F.col("q_spacegroup_number"))).otherwise(F.abs(F.col("crystal_system_code") - F.col("q_crystal_system_code"))).cast("double")
    return both.select(
        "*",
        overlap.alias("element_overlap_count"),
        (overlap / F.greatest(F.size("q_elements"), F.lit(1))).alias("element_overlap_fraction"),
        *[F.coalesce(F.col(c).cast("string") == F.col(f"q_{c}"), F.lit(False)).alias(f"same_{c}") for c in FLAGS],
        F.coalesce(distance == 0, F.lit(False)).alias("symmetry_match"),
        distance.alias("symmetry_distance"),
    )


def _one(flag: str) -> Column:
    return F.col(flag).cast("double")


def _not(flag: str) -> Column:
    return F.lit(1.0) - F.col(flag).cast("double")


def eligibility(config: PoolConfig) -> dict[str, Column]:
    """Who may enter each pool."""
    same = [F.col(f"same_{c}") for c in FLAGS]
    anywhere = reduce(lambda a, b: a | b, same)
    related = F.col("same_material_family") | F.col("same_formula_family") | F.col("same_prototype_family") | F.col("same_composition_family")
    overlap, fraction = F.col("element_overlap_count"), F.col("element_overlap_fraction")
    twin = F.col("same_structure_variant") & F.col("same_prototype_family")
    return {
        "same_family": anywhere & ~F.coalesce(F.col("formula") == F.col("query_formula"), F.lit(False)),
        "adjacent_family": (overlap >= config.adjacent_least_overlap) & ~F.col("same_chemical_system") & (related | (fraction >= 0.34)) & ~twin,
        "boundary_contrast": (related | (overlap >= 1)) & ~F.col("symmetry_match") & F.col("symmetry_distance").isNotNull(),
        "wildcard": F.lit(True),
        "negative_control": (overlap <= config.control_most_overlap) & ~anywhere,
    }


def scores() -> dict[str, Column]:
    """The score of each pool."""
    fraction, stable = F.col("element_overlap_fraction"), _one("is_stable_or_known")
    return {
        "same_family": 4.0 * _one("same_chemical_system") + 3.5 * _one("same_prototype_family") + 2.5 * _one("same_formula_family") + 2.0 * _one("same_structure_variant")
        + 1.5 * _one("same_material_family") + 0.75 * _one("same_composition_family") + 2.0 * fraction + 0.75 * _one("symmetry_match") + 0.5 * stable,
        "adjacent_family": 3.0 * fraction + 2.0 * _one("same_prototype_family") + 1.5 * _one("same_formula_family") + _one("same_material_family") + 0.75 * _one("same_composition_family")
        + 0.75 * stable + F.lit(0.5) / (F.lit(1.0) + F.coalesce("symmetry_distance", F.lit(50.0))),
        "boundary_contrast": F.least(F.col("symmetry_distance") / 50.0, F.lit(2.0)) + 1.5 * fraction + 2.0 * _one("same_prototype_family") + 1.5 * _one("same_formula_family")
        + 0.75 * _one("same_material_family") + 0.5 * _one("same_composition_family") + 0.75 * _not("same_structure_variant") + 0.5 * stable,
        "wildcard": 2.0 * stable + 0.5 * fraction + 0.25 * F.col("formation_energy").isNotNull().cast("double") + 0.25 * F.col("spacegroup_number").isNotNull().cast("double"),
        "negative_control": 3.0 * (F.lit(1.0) - fraction) + _not("same_composition_family") + _not("same_material_family") + 0.75 * _not("same_formula_family") + 0.75 * _not("same_prototype_family")
        + _not("same_chemical_system") + 0.25 * stable,
    }


#: the last two pools draw with seeds of their own
SEED_OFFSETS = {"same_family": 0, "adjacent_family": 0, "boundary_contrast": 0, "wildcard": 17, "negative_control": 31}


def _order() -> list[Column]:
    return [F.desc("selection_score"), F.desc("is_stable_or_known"), F.desc("element_overlap_count"), F.asc("jitter"), F.asc("candidate_id")]


@dataclass(frozen=True)
class Room:
    """How many rows of a system (``None``: all) and of a pool may be chosen."""

    system: int | None
    pool: int

    @staticmethod
    def of(config: PoolConfig, name: str) -> Room:
        return Room(config.quotas[name] or None, config.sizes[name])

    def besides(self, taken: list[Room]) -> Room:
        """Room that holds every row that can be chosen once up to ``taken`` rows are left out.

        Of a system, at most its share of what is taken stands before a row that
        is chosen. Of a pool, at most what is taken, and with a quota the rows
        beyond it of systems that the pool draws on.
        """
        gone = sum(t.pool for t in taken)
        if self.system is None:
            return Room(None, self.pool + gone)
        system = self.system + sum(t.pool if t.system is None else min(t.system, t.pool) for t in taken)
        return Room(system, self.pool * system + gone)


def entries(annotated: DataFrame, rooms: Mapping[str, Room], config: PoolConfig, *, everybody: bool = False) -> DataFrame:
    """Ranked entries of pools: query_id, candidate_id, pool_name, system and the order's columns.

    ``annotated`` is read once for all pools. Spark cuts both ranks before their
    exchanges. With ``everybody`` nobody is ineligible.
    """
    able = eligibility(config)
    offers = [F.when(F.lit(True) if everybody else able[n], F.struct(F.lit(n).alias("pool_name"), F.round(F.coalesce(scores()[n], F.lit(0.0)), 9).alias("selection_score"), F.col(f"__jitter{SEED_OFFSETS[n]}").alias("jitter"))) for n in rooms]
    system = F.coalesce(text_or_null(F.col("chemical_system")), F.lit("UNKNOWN")).alias("system")
    long = annotated.select("query_id", "candidate_id", system, "is_stable_or_known", "element_overlap_count", F.explode(F.array_compact(F.array(*offers))).alias("e"))
    long = long.select("query_id", "candidate_id", "system", "is_stable_or_known", "element_overlap_count", "e.*")
    return cut(long, rooms)


def cut(rows: DataFrame, rooms: Mapping[str, Room]) -> DataFrame:
    """``rows`` within the rooms of their pools, with ``rank_in_pool``.

    Going down the order and skipping full systems keeps exactly the rows whose
    rank within their system is inside the quota; so two ranks do it.
    """

    def within(of: str) -> Column:
        limit = F.lit(None).cast("long")
        for name, room in rooms.items():
            limit = F.when(F.col("pool_name") == name, F.lit(getattr(room, of)).cast("long")).otherwise(limit)
        return limit

    quotas = [r.system for r in rooms.values()]
    if any(q is not None for q in quotas):
        ranked = rows.withColumn("__s", F.row_number().over(Window.partitionBy("query_id", "pool_name", "system").orderBy(*_order())))
        if all(q is not None for q in quotas):
            ranked = ranked.filter(F.col("__s") <= max(quotas))
        rows = ranked.filter(within("system").isNull() | (F.col("__s") <= within("system"))).drop("__s")
    ranked = rows.withColumn("rank_in_pool", F.row_number().over(Window.partitionBy("query_id", "pool_name").orderBy(*_order())))
    return ranked.filter(F.col("rank_in_pool") <= max(r.pool for r in rooms.values())).filter(F.col("rank_in_pool") <= within("pool"))


def _with_jitter(universe: DataFrame, config: PoolConfig) -> DataFrame:
    """``universe`` with the places of candidates of equal standing, one for each seed."""
    return universe.withColumns({f"__jitter{o}": stable_fraction(config.seed + o, F.col("jid")) for o in sorted(set(SEED_OFFSETS.values()))})


def all_pools(universe: DataFrame, queries: DataFrame, config: PoolConfig = PoolConfig()) -> DataFrame:
    """The five pools of all queries as one table.

    The first three may share candidates; wildcards leave out all of them, and
    controls leave out the wildcards as well. The pass over universe and queries
    yields entries of all five, of the last two so many that enough remain
    whatever is left out; it is written once. Where nobody is eligible as control,
    everybody is; such queries, if there are any, meet the universe again.
    """
    jittered = _with_jitter(universe, config)
    first, wild, control = POOLS[:3], POOLS[3], POOLS[4]
    own = {n: Room.of(config, n) for n in POOLS}
    taken = [own[n] for n in first]
    rooms = {n: own[n] for n in first} | {wild: own[wild].besides(taken), control: own[control].besides([*taken, own[wild]])}
    drawn = cut_lineage(entries(flags(_meet(jittered, queries, config)), rooms, config))
    chosen = drawn.filter(F.col("pool_name").isin(list(first)))
    ids = chosen.select("query_id", "candidate_id").distinct()

    def left(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
        rest = rows.filter(F.col("pool_name") == name).drop("rank_in_pool").join(gone, ["query_id", "candidate_id"], "left_anti")
        return cut(rest, {name: own[name]})

    wilds = cut_lineage(left(drawn, wild, ids))
    gone = ids.unionByName(wilds.select("query_id", "candidate_id"))
    controls = cut_lineage(left(drawn, control, gone))
    parts = [chosen, wilds, controls]
    unserved = cut_lineage(queries.join(controls.select("query_id").distinct(), "query_id", "left_anti"))
    if own[control].pool > 0 and not unserved.isEmpty():
        again = entries(flags(_meet(jittered, unserved, config)), {control: rooms[control]}, config, everybody=True)
        parts.append(left(again, control, gone))
    names = ["query_id", "candidate_id", "pool_name", "rank_in_pool", "selection_score"]
    # columns of their own, as a stream's batch can't be told apart from what was made of it
    picked = reduce(DataFrame.unionByName, parts).select(*[F.col(c).alias(c) for c in names])
    full = flags(picked.join(candidates(universe, config), "candidate_id").join(queries, "query_id"))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in MISSING_CHECKED])), ";")
    return full.withColumn("missing_fields", missing)


def in_blocks(universe: DataFrame, queries: DataFrame, config: PoolConfig = PoolConfig()) -> DataFrame:
    """:func:`all_pools` for any number of queries, ``queries_per_block`` at a time."""
    blocks = max(1, -(-queries.count() * 5 // (4 * config.queries_per_block)))
    if blocks == 1:
        return all_pools(universe, queries, config)
    numbered = cut_lineage(queries.withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    parts = [cut_lineage(all_pools(universe, numbered.filter(F.col("__b") == b).drop("__b"), config)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
