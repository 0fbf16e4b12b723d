"""Ranked reference pools for many query entities, without an entry of them ever exchanged.

Chooses the same rows as :mod:`vicinage.operators.retrieval` (whose scores and
eligibility it repeats in NumPy; tests hold the two together). The universe is written
once, in pieces of bounded size by ranges of candidate ids, as a narrow table that
workers read. Only the queries are spread; a worker holds its queries against one
piece after the other and yields rows as they are to be reported.

Rows of a piece that differ in nothing but formula, formula family, symmetry and
stability are a block. A query meets blocks; how many candidates each level of their
scores can give bounds the score that a row must reach, and only blocks that can
reach it are opened.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.functions.scalars import stable_fraction, text_or_null
from vicinage.operators.retrieval import FLAGS, MISSING_CHECKED, POOLS, SEED_OFFSETS, PoolConfig, candidates
from vicinage.session import checkpoint_folder

ROWS_PER_PIECE = 250_000  # aimed at; a place within a piece has PLACE_BITS
PLACE_BITS, OVERLAP_BITS = 20, 7
PIECES_KEPT = 4
QUERIES_PER_TASK = 256
BLOCK_FLAGS = ("composition_family", "material_family", "prototype_family", "structure_variant")
CF, MF, PF, SV, SYSTEM = 1, 2, 4, 8, 16  # bits of a block's level, below its overlap
CAP = 25  # of a block's rows as many steer how many levels are opened at once; what is chosen doesn't depend on it
GAP = "\x1f"
REPORTED = "query_id string, candidate_id string, pool_name string, rank_in_pool int, selection_score double, element_overlap_count int, same_chemical_system boolean, same_prototype_family boolean, same_material_family boolean, symmetry_distance double, is_stable_or_known boolean, missing_fields string"


def chosen(universe: DataFrame, queries: DataFrame, config: PoolConfig = PoolConfig(), *, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """The five pools of any number of queries, with the columns of ``REPORTED``.

    ``universe`` has one row per id. It is read once; ``rows_per_piece`` bounds what a
    worker holds, not what is compared.
    """
    spark = universe.sparkSession
    pieces = _write_pieces(universe, config, rows_per_piece)
    n = queries.count()
    asked = queries.select("query_id", "query_formula", F.array_distinct("q_elements").alias("q_elements"), F.size("q_elements").alias("q_size"), *[F.col(f"q_{c}") for c in FLAGS], "q_spacegroup_number", "q_crystal_system_code")
    spread = asked.repartition(max(1, min(-(-n // 8), max(-(-n // QUERIES_PER_TASK), 3 * spark.sparkContext.defaultParallelism))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            step = 16 if len(pieces) <= PIECES_KEPT else QUERIES_PER_TASK
            for i in range(0, len(rows), step):
                yield from _answer(rows[i : i + step], pieces, config)

    return spread.mapInArrow(scan, REPORTED)


def _write_pieces(universe: DataFrame, config: PoolConfig, rows_per_piece: int) -> list[str]:
    """Files of the narrow universe, in the order of candidate ids."""
    spark = universe.sparkSession
    rows = candidates(universe, config).filter(F.col("candidate_id").isNotNull())
    narrow = rows.select(
        "candidate_id",
        F.col("formula").cast("string").alias("formula"),
        F.array_join("elements", GAP).alias("elements"),
        *[F.col(c).cast("string").alias(c) for c in FLAGS],
        F.coalesce(text_or_null(F.col("chemical_system")), F.lit("UNKNOWN")).alias("system"),
        F.col("spacegroup_number").cast("int").alias("spacegroup_number"),
        F.col("crystal_system_code").cast("int").alias("crystal_system_code"),
        "is_stable_or_known",
        F.col("formation_energy").isNotNull().alias("has_energy"),
        *[stable_fraction(config.seed + o, F.col("candidate_id")).alias(f"jitter{o}") for o in sorted(set(SEED_OFFSETS.values()))],
        F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in MISSING_CHECKED])), ";").alias("missing_fields"),
    )
    n = universe.count()
    folder = f"{checkpoint_folder(spark)}/pieces-{uuid.uuid4().hex}"
    narrow.repartitionByRange(max(1, -(-n // rows_per_piece)), "candidate_id").write.parquet(folder)
    files, path = _open(folder)
    return sorted(f"{folder}/{f.base_name}" for f in files.get_file_info(pf.FileSelector(path)) if f.base_name.endswith(".parquet"))


def _open(name: str) -> tuple[pf.FileSystem, str]:
    if name.startswith("file:"):
        return pf.LocalFileSystem(), "/" + name[5:].lstrip("/")
    return pf.FileSystem.from_uri(name) if "://" in name else (pf.LocalFileSystem(), name)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[str, int]]:
    """Codes of a text column (-1: null) and the code of each text."""
    coded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), {v: i for i, v in enumerate(coded.dictionary.to_pylist())}


def _together(*codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and code of each combination."""
    one = np.zeros(len(codes[0]), np.int64)
    for c in codes:
        one = np.unique(one * (c.max(initial=0) + 2) + c + 1, return_inverse=True)[1]
    _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
    return first, inverse


class Piece:
    """A part of the universe, its rows ordered by block."""

    def __init__(self, name: str) -> None:
        files, path = _open(name)
        table = pq.read_table(path, filesystem=files)
        table = table.take(pc.sort_indices(table["candidate_id"]))
        self.ids, n = table["candidate_id"].combine_chunks(), len(table)
        if n >= 1 << PLACE_BITS:
            raise ValueError(f"a piece of {n} rows; fewer rows per piece are needed")
        flags = {c: _codes(table[c]) for c in (*BLOCK_FLAGS, "chemical_system", "elements")}
        first, family = _together(*[flags[c][0] for c in BLOCK_FLAGS])
        self.families = {c: flags[c][0][first] for c in BLOCK_FLAGS}
        self.words = {c: flags[c][1] for c in (*BLOCK_FLAGS, "chemical_system")}
        first, block = _together(flags["elements"][0], flags["chemical_system"][0], family)
        order = np.argsort(block, kind="stable")
        self.family_of = family[first]
        self.chemical_of = flags["chemical_system"][0][first]
        self.counts = np.bincount(block, minlength=len(first))
        self.starts = np.cumsum(self.counts) - self.counts
        sets = [set(t.split(GAP)) - {""} for t in flags["elements"][1]]
        if max(map(len, sets), default=0) >= 1 << OVERLAP_BITS:
            raise ValueError(f"a record of {1 << OVERLAP_BITS} elements or more")
        self.symbols = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
        holds = np.zeros((len(self.symbols), len(sets)), np.uint8)
        for j, found in enumerate(sets):
            holds[[self.symbols[s] for s in found], j] = 1
        self.holds = np.ascontiguousarray(holds[:, flags["elements"][0][first]])
        table = table.take(pa.array(order))
        self.block, self.by_id = block[order].astype(np.int32), order
        self.rows_by_id = np.argsort(order)
        self.missing, self.systems = (table[c].combine_chunks() for c in ("missing_fields", "system"))
        self.system = _codes(table["system"])[0].astype(np.int32)
        self.jitter, self.place = {}, {}
        for o in set(SEED_OFFSETS.values()):
            self.jitter[o] = table[f"jitter{o}"].to_numpy()
            self.place[o] = np.empty(n, np.int32)
            self.place[o][np.lexsort((self.by_id, self.jitter[o]))] = np.arange(n)
        group, crystal = (pc.fill_null(table[c].cast(pa.int64()), -1).to_numpy() for c in ("spacegroup_number", "crystal_system_code"))
        first, symmetry = _together(group, crystal)
        as_float = lambda c: table[c].cast(pa.float64()).to_numpy()[first]
        self.group, self.crystal = as_float("spacegroup_number"), as_float("crystal_system_code")
        self.stable = table["is_stable_or_known"].to_numpy().astype(np.int64)
        self.row_class = (symmetry * 4 + self.stable * 2 + table["has_energy"].to_numpy()).astype(np.int32)
        self.classes = np.bincount(self.row_class, minlength=4 * len(first)) > 0
        self.formula_family, self.words["formula_family"] = _codes(table["formula_family"])
        self.formulas, self.words["formula"] = _codes(table["formula"])
        self.by_formula_family, self.by_formula = np.argsort(self.formula_family, kind="stable"), np.argsort(self.formulas, kind="stable")
        self.sorted_formula_family, self.sorted_formula = self.formula_family[self.by_formula_family], self.formulas[self.by_formula]
        self.out = np.zeros(n, bool)
        self.capped = np.minimum(self.counts, CAP).astype(float)

    def row_of(self, key: str | None) -> np.ndarray:
        """The row of an id, if it is here; ids are in order, rows aren't."""
        at = bisect_left(range(len(self.ids)), key, key=lambda i: self.ids[i].as_py()) if key is not None else len(self.ids)
        there = at < len(self.ids) and self.ids[at].as_py() == key
        return self.rows_by_id[at : at + there]

    def rows_with(self, column: str, text: str | None) -> np.ndarray:
        code = self.words[column].get(text, -2) if text is not None else -2
        values, order = (self.sorted_formula, self.by_formula) if column == "formula" else (self.sorted_formula_family, self.by_formula_family)
        return order[np.searchsorted(values, code) : np.searchsorted(values, code, "right")]

    def rows_of(self, blocks: np.ndarray) -> np.ndarray:
        counts = self.counts[blocks]
        ends = np.cumsum(counts)
        return np.repeat(self.starts[blocks] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


_piece = lru_cache(maxsize=PIECES_KEPT)(Piece)


class Met:
    """A query against a piece: levels of blocks, distances, the rows of its formula family and formula."""

    def __init__(self, piece: Piece, q: dict[str, Any]) -> None:
        self.piece, self.itself = piece, piece.row_of(q["query_id"])
        family = np.zeros(len(piece.families[BLOCK_FLAGS[0]]), np.uint16)
        for c, bit in zip(BLOCK_FLAGS, (CF, MF, PF, SV)):
            if (code := piece.words[c].get(q[f"q_{c}"])) is not None:
                family[piece.families[c] == code] |= bit
        self.level = family[piece.family_of]
        held = [i for s in q["q_elements"] or [] if (i := piece.symbols.get(s)) is not None]
        if held:
            overlap = piece.holds[held[0]].copy()
            for i in held[1:]:
                overlap += piece.holds[i]
            self.level += overlap.astype(np.uint16) << 5
        if (code := piece.words["chemical_system"].get(q["q_chemical_system"])) is not None:
            self.level[piece.chemical_of == code] |= SYSTEM
        self.size, self.top = max(q["q_size"] or 0, 1), len(held)
        by_group = q["q_spacegroup_number"] is not None
        own = q["q_spacegroup_number"] if by_group else q["q_crystal_system_code"]
        self.distance = np.abs((piece.group if by_group else piece.crystal) - (np.nan if own is None else own))
        self.related = piece.rows_with("formula_family", q["q_formula_family"])
        self.equal = piece.rows_with("formula", q["query_formula"])
        self.related_level, self.related_class = self.level[piece.block[self.related]], piece.row_class[self.related]
        self.room = np.bincount(self.level, piece.capped, minlength=(self.top + 1) << 5)

    def of_row_class(self, pool: str) -> np.ndarray:
        """What symmetry, stability and the energy add to a score; ``-inf``: not eligible."""
        d = self.distance
        stable, energy = {"same_family": 0.5, "adjacent_family": 0.75, "boundary_contrast": 0.5, "wildcard": 2.0, "negative_control": 0.25}[pool], 0.25 * (pool == "wildcard")
        if pool == "same_family":
            by_symmetry = 0.75 * (d == 0)
        elif pool == "adjacent_family":
            by_symmetry = 0.5 / (1.0 + np.where(np.isnan(d), 50.0, d))
        elif pool == "boundary_contrast":
            by_symmetry = np.where(np.isnan(d) | (d == 0), -np.inf, np.minimum(d / 50.0, 2.0))
        else:
            by_symmetry = 0.25 * ~np.isnan(self.piece.group) if pool == "wildcard" else np.zeros(len(d))
        return (by_symmetry[:, None] + np.array([0.0, energy, stable, stable + energy])).ravel()


@lru_cache(maxsize=4096)
def _levels(pool: str, size: int, top: int, least: int, most: int, everybody: bool) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Scores and eligibility of levels, for rows of another and of the query's formula family."""
    level = np.arange((top + 1) << 5)
    overlap = level >> 5
    fraction = overlap / size
    cf, mf, pf_, sv, system = ((level & bit) > 0 for bit in (CF, MF, PF, SV, SYSTEM))
    both = []
    for ff in (np.zeros(len(level), bool), np.ones(len(level), bool)):
        anywhere, related = cf | mf | pf_ | sv | system | ff, mf | ff | pf_ | cf
        if pool == "same_family":
            score, able = 4.0 * system + 3.5 * pf_ + 2.5 * ff + 2.0 * sv + 1.5 * mf + 0.75 * cf + 2.0 * fraction, anywhere
        elif pool == "adjacent_family":
            score, able = 3.0 * fraction + 2.0 * pf_ + 1.5 * ff + 1.0 * mf + 0.75 * cf, (overlap >= least) & ~system & (related | (fraction >= 0.34)) & ~(sv & pf_)
        elif pool == "boundary_contrast":
            score, able = 1.5 * fraction + 2.0 * pf_ + 1.5 * ff + 0.75 * mf + 0.5 * cf + 0.75 * ~sv, related | (overlap >= 1)
        elif pool == "wildcard":
            score, able = 0.5 * fraction, np.ones(len(level), bool)
        else:
            score, able = 3.0 * (1.0 - fraction) + 1.0 * ~cf + 1.0 * ~mf + 0.75 * ~ff + 0.75 * ~pf_ + 1.0 * ~system, (overlap <= most) & ~anywhere
        both.append((score, able | everybody))
    return tuple(both)


def _within(keys: np.ndarray, systems: np.ndarray, size: int, quota: int | None) -> np.ndarray:
    """Positions of the ``size`` greatest keys, at most ``quota`` of a system, in order."""
    n, take = len(keys), 4 * size
    while True:
        some = np.argpartition(keys, n - take)[n - take :] if take < n else np.arange(n)
        some = some[np.argsort(keys[some])[::-1]]
        kept = some if quota is None else some[_rank_of(systems[some]) < quota]
        if len(kept) >= size or take >= n:
            return kept[:size]
        take *= 4


def _rank_of(systems: np.ndarray) -> np.ndarray:
    """How often the value stood before."""
    n = len(systems)
    order = np.argsort(systems, kind="stable")
    ordered = systems[order]
    at = np.arange(n)
    begins = np.zeros(n, np.int64)
    begins[1:] = np.where(ordered[1:] != ordered[:-1], at[1:], 0)
    rank = np.empty(n, np.int64)
    rank[order] = at - np.maximum.accumulate(begins)
    return rank


def _pick(met: Met, pool: str, config: PoolConfig, everybody: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the piece chosen for a pool, best first, and their keys; rows in ``piece.out`` are left out."""
    piece, size, quota = met.piece, config.sizes[pool], config.quotas[pool] or None
    (score, able), (score_ff, able_ff) = _levels(pool, met.size, met.top, config.adjacent_least_overlap, config.control_most_overlap, everybody)
    added = met.of_row_class(pool)
    place = piece.place[SEED_OFFSETS[pool]]

    def keyed(rows: np.ndarray, s: np.ndarray, level: np.ndarray) -> np.ndarray:
        key = np.floor(s * 1e9 + 0.5).astype(np.int64)
        key = ((key << 1 | piece.stable[rows]) << OVERLAP_BITS | (level >> 5)) << PLACE_BITS
        return key | ((1 << PLACE_BITS) - 1 - place[rows])

    def opened(levels: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.zeros(len(score), bool)
        mask[levels] = True
        blocks = np.flatnonzero(mask[met.level])
        rows = piece.rows_of(blocks)
        level = np.repeat(met.level[blocks], piece.counts[blocks])
        s = score[level] + added[piece.row_class[rows]]
        keep = np.flatnonzero(s >= least)
        rows, s, level = rows[keep], s[keep], level[keep]
        stay = ~piece.out[rows]
        if len(met.related):
            stay &= piece.formula_family[rows] != piece.formula_family[met.related[0]]
        return rows[stay], s[stay], level[stay]

    lowest = -1.0  # below every score; of those not eligible, -inf
    keep = np.flatnonzero(able_ff[met.related_level])
    rows, level = met.related[keep], met.related_level[keep]
    s = score_ff[level] + added[met.related_class[keep]]
    keep = (s >= lowest) & ~piece.out[rows]
    rows, s = rows[keep], s[keep]
    keys = keyed(rows, s, level[keep])
    levels = np.flatnonzero(able & (met.room > 0))
    levels = levels[np.argsort(-score[levels], kind="stable")]
    room, highest, wanted = np.cumsum(met.room[levels]), added[piece.classes].max(initial=-np.inf), 2 * size
    done, least = 0, lowest
    while True:
        rest = levels[done:]
        rest = rest[score[rest] + highest >= least]
        if len(keys) >= size or not len(rest):
            best = _within(keys, piece.system[rows], size, quota)
            rows, keys, s = rows[best], keys[best], s[best]
            if len(best) == size:
                # no row below the last of these can be chosen any more
                least = s[-1] - 1e-8
                rest = rest[score[rest] + highest >= least]
            if not len(rest):
                return rows, keys
        # levels are in order, so those that can still count come first
        upto = min(max(int(np.searchsorted(room, wanted)) + 1, done + 1), done + len(rest))
        rest, done, wanted = levels[done:upto], upto, 4 * wanted
        more = opened(rest, least)
        rows, keys, s = np.concatenate([rows, more[0]]), np.concatenate([keys, keyed(*more)]), np.concatenate([s, more[1]])


class Choice:
    """The rows chosen so far for a query and a pool, over pieces."""

    def __init__(self) -> None:
        self.parts: list[dict[str, np.ndarray]] = []

    def add(self, met: Met, at: int, pool: str, rows: np.ndarray, keys: np.ndarray, config: PoolConfig, single: bool) -> None:
        piece, level = met.piece, met.level[met.piece.block[rows]]
        part = {"piece": np.full(len(rows), at), "row": rows, "key": keys >> PLACE_BITS, "level": level, "distance": met.distance[piece.row_class[rows] >> 2]}
        if single:
            self.parts = [part]
            return
        part |= {"jitter": piece.jitter[SEED_OFFSETS[pool]][rows], "id": piece.by_id[rows], "system": piece.systems.take(pa.array(rows)).to_numpy(zero_copy_only=False)}
        both = {k: np.concatenate([p[k] for p in (*self.parts, part)]) for k in part}
        order = np.lexsort((both["id"], both["piece"], both["jitter"], -both["key"]))
        if quota := config.quotas[pool]:
            order = order[_rank_of(np.unique(both["system"][order].astype(str), return_inverse=True)[1]) < quota]
        self.parts = [{k: v[order[: config.sizes[pool]]] for k, v in both.items()}]

    def __len__(self) -> int:
        return sum(len(p["row"]) for p in self.parts)

    def rows(self, at: int) -> np.ndarray:
        return np.concatenate([p["row"][p["piece"] == at] for p in self.parts] or [np.zeros(0, np.int64)])


def _answer(queries: list[dict[str, Any]], names: list[str], config: PoolConfig) -> Iterator[pa.RecordBatch]:
    """The pools of some queries: the first three, then wildcards without these, then controls without all of them."""
    first, wild, control = POOLS[:3], POOLS[3], POOLS[4]
    chosen = [{n: Choice() for n in POOLS} for _ in queries]
    kept: dict[tuple[int, int], Met] = {}
    for pools, everybody in ((first, False), ((wild,), False), ((control,), False), ((control,), True)):
        pools = [n for n in pools if config.sizes[n] > 0]
        todo = [i for i in range(len(queries)) if pools and not (everybody and len(chosen[i][control]))]
        if not todo:
            continue
        earlier = POOLS[: POOLS.index(pools[0])] if pools[0] not in first else ()
        for at, name in enumerate(names):
            piece = _piece(name)
            if not len(piece.ids):
                continue
            for i in todo:
                if (met := kept.get((at, i))) is None:
                    met = Met(piece, queries[i])
                    if len(names) <= PIECES_KEPT:
                        kept[at, i] = met
                gone = np.concatenate([met.itself, *[chosen[i][n].rows(at) for n in earlier]])
                for n in pools:
                    out = np.concatenate([gone, met.equal]) if n == "same_family" else gone
                    piece.out[out] = True
                    rows, keys = _pick(met, n, config, everybody)
                    piece.out[out] = False
                    chosen[i][n].add(met, at, n, rows, keys, config, len(names) == 1)
    yield from _reported(queries, chosen, names)


def _reported(queries: list[dict[str, Any]], chosen: list[dict[str, Choice]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What is chosen, by piece, with the columns of ``REPORTED``."""
    parts = [(i, k, p) for i, of in enumerate(chosen) for k, n in enumerate(POOLS) for p in of[n].parts if len(p["row"])]
    if not parts:
        return
    lengths = [len(p["row"]) for *_, p in parts]
    all_ = {k: np.concatenate([p[k] for *_, p in parts]) for k in ("piece", "row", "key", "level", "distance")}
    all_ |= {"query": np.repeat([i for i, *_ in parts], lengths), "pool": np.repeat([k for _, k, _ in parts], lengths), "rank": np.concatenate([np.arange(1, n + 1) for n in lengths])}
    ids, pools = pa.array([q["query_id"] for q in queries], pa.string()), pa.array(POOLS, pa.string())
    for at, name in enumerate(names):
        here = all_ if len(names) == 1 else {k: v[all_["piece"] == at] for k, v in all_.items()}
        if not len(here["row"]):
            continue
        piece, rows, level, key = _piece(name), pa.array(here["row"]), here["level"], here["key"]
        columns = {
            "query_id": ids.take(pa.array(here["query"])),
            "candidate_id": piece.ids.take(pa.array(piece.by_id[here["row"]])),
            "pool_name": pools.take(pa.array(here["pool"])),
            "rank_in_pool": pa.array(here["rank"].astype(np.int32)),
            "selection_score": pa.array((key >> (OVERLAP_BITS + 1)) / 1e9),
            "element_overlap_count": pa.array((level >> 5).astype(np.int32)),
            "same_chemical_system": pa.array((level & SYSTEM) > 0),
            "same_prototype_family": pa.array((level & PF) > 0),
            "same_material_family": pa.array((level & MF) > 0),
            "symmetry_distance": pa.array(here["distance"], mask=np.isnan(here["distance"])),
            "is_stable_or_known": pa.array((key >> OVERLAP_BITS & 1) > 0),
            "missing_fields": piece.missing.take(rows),
        }
        yield pa.RecordBatch.from_pydict(columns)
