"""All pairs of records whose sets overlap above a threshold, by chosen paths.

Records start in one node. A node with more than ``leaf`` records is split:
under a random order of the tokens, drawn afresh from the hash of the node's
path, every record follows as many of its first tokens as it takes for any
partner of sufficient similarity to follow at least one of the same tokens, and
so lands in the child nodes of those tokens. Small nodes are compared record by
record, and every candidate is verified on the sets themselves.

How many tokens to follow: a partner of a set of ``s`` tokens shares at least
``ceil(t*s)`` of them, so one of the first ``s - ceil(t*s) + 1`` shared or not
tokens of *both* sets is common to both: take the first shared token in the
node's order; fewer than ``s - ceil(t*s) + 1`` tokens can stand before it in
either set. The argument holds for any order and again inside the child for the
tokens that are left. A single tree therefore has recall 1. With
``sampled_recall`` below 1 each record follows fewer tokens, and trees are
repeated until the recall is reached.

The random order is weighted: a token's place is an exponential variate times
the number of sets that hold it, so rare tokens tend to come first and children
are small.

When to stop: a node is split only while that saves comparisons, that is while
the squares of its children's sizes sum to less than the square of its own. A
node of near-copies doesn't shrink, as its records follow the same few tokens;
it is compared where it stands, in blocks. Records that share all but their
rarest tokens are partners of each other, so what such a node compares are
mostly pairs of the result. Every record passes at most ``s - ceil(t*s) + 1``
times into the children of a node that stops, and those are dropped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.session import cut_lineage


def least_overlap(size: Column, threshold: float) -> Column:
    """The least number of shared tokens of a set of ``size`` with a partner of Jaccard similarity ``threshold``.

    A small slack keeps products such as 0.8 * 10 from being rounded up.
    """
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")


def signature(tokens: Column) -> Column:
    """64-bit sketch of a set: the bits of its hashed tokens."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))


def distinct_sets(records: DataFrame, *, record: str, tokens: str, least_size: int) -> tuple[DataFrame, DataFrame]:
    """``(sets, members)``: the distinct sets of at least ``least_size`` tokens and the records that hold them.

    Token order and repetition don't matter; null tokens don't count. Records
    with a null id or array have no set. Both tables carry the set's ``set_id``,
    a 128-bit hash of its sorted tokens as 16 bytes.
    """
    rows = records.select(records[record].alias("record"), F.array_sort(F.array_distinct(F.array_compact(records[tokens].cast("array<string>")))).alias("tokens"))
    rows = rows.filter(F.col("record").isNotNull() & (F.size("tokens") >= least_size))
    rows = rows.withColumn("set_id", F.unhex(F.md5(F.to_json(F.struct("tokens")))))
    members = rows.select("set_id", "record").distinct()
    sets = rows.groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    return sets, members


def _weighted(sets: DataFrame) -> DataFrame:
    """``set_id``, ``size`` and ``rest``: the tokens as hashes with the number of sets that hold them."""
    long = sets.select("set_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).select("set_id", "size", F.xxhash64("token").alias("t"))
    held = long.groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return long.join(held, "t").groupBy("set_id", "size").agg(F.collect_list(F.struct("t", "w")).alias("rest"))


def _children(nodes: DataFrame, threshold: float, seed: int, follow: float) -> DataFrame:
    """The records of ``nodes`` (path, n, set_id, size, rest) in their child nodes;
    ``parent`` and ``n_parent`` name the node they come from.

    Hashing path and token gives each node its own random token order.
    """
    full = F.col("size") - least_overlap(F.col("size"), threshold) + 1
    wanted = F.greatest(F.lit(1), F.ceil(full * F.lit(follow)).cast("int"))
    hashed = F.transform(F.col("rest"), lambda r: F.struct(F.xxhash64(F.lit(seed), F.col("path"), r["t"]).alias("h"), r["t"].alias("t"), r["w"].alias("w")))
    # an exponential variate of mean w; the hash settles what ties there may be
    place = lambda r: -F.ln((F.shiftrightunsigned(r["h"], 11) + 1) / float(2**53 + 2)) * r["w"]
    ordered = F.array_sort(F.transform(hashed, lambda r: F.struct(place(r).alias("place"), r["h"].alias("h"), r["t"].alias("t"))))
    branched = nodes.select("path", "n", "set_id", "size", "rest", F.explode(F.slice(ordered, F.lit(1), wanted)).alias("c"))
    return branched.select(
        F.col("path").alias("parent"),
        F.col("n").alias("n_parent"),
        F.col("c.h").alias("path"),
        "set_id",
        "size",
        F.filter("rest", lambda r: r["t"] != F.col("c.t")).alias("rest"),
    )


def trees_for(recall: float, threshold: float, follow: float, depth: int) -> int:
    """Trees needed for ``recall`` when each record follows only part of its tokens.

    A pair at the threshold keeps together on a level with a probability of at
    least ``threshold * follow`` (its first token is shared with a probability of
    its similarity), and on ``depth`` levels with the power of it.
    """
    if follow >= 1:
        return 1
    together = (threshold * follow) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def similar_sets(
    sets: DataFrame,
    *,
    threshold: float,
    leaf: int = 256,
    block: int = 1024,
    follow: float = 1.0,
    sampled_recall: float = 0.99,
    seed: int = 5,
) -> DataFrame:
    """Pairs of distinct sets: ``set_a`` < ``set_b`` and ``similarity`` >= ``threshold``.

    Nodes of more than ``leaf`` sets are split while that saves comparisons.
    Sets of a node that is split, whose least overlap is spent by the path, may
    share nothing more with each other and are compared there; they exceed the
    path by few tokens. Whatever has more than ``block`` sets is compared in
    blocks, so that no task ever holds an unbounded group.
    """
    total = sets.count()
    coded = cut_lineage(_weighted(sets))
    found = None
    for tree in range(trees_for(sampled_recall, threshold, follow, 3)):
        level = coded.select(F.lit(0).cast("long").alias("path"), F.lit(total).cast("long").alias("n"), "set_id", "size", "rest")
        leaves, depth = [], 0
        if total <= leaf:
            leaves, level = [level.select("path", "n", "set_id")], level.limit(0)
        while leaves == [] or not level.isEmpty():
            children = cut_lineage(_children(level.filter(F.size("rest") > 0), threshold, seed + tree, follow))
            depth += 1
            is_spent = least_overlap(F.col("size"), threshold) <= depth
            counts = children.groupBy("parent", "n_parent", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(is_spent.cast("long")).alias("n_spent"))
            cost = counts.groupBy("parent").agg((F.sum(F.col("n").cast("double") * F.col("n")) >= F.max(F.col("n_parent").cast("double") * F.col("n_parent"))).alias("dense"))
            counts = cut_lineage(counts.join(cost, "parent"))
            # one row per node of more than `leaf` sets and per child
            dense = counts.filter("dense").select(F.col("parent").alias("path")).distinct()
            leaves.append(level.join(dense, "path", "left_semi").select("path", "n", "set_id"))
            open_ = children.join(counts.filter("NOT dense AND n > 1").select("path", "n", "n_spent"), "path")
            leaves.append(open_.filter(F.col("n") <= leaf).select("path", "n", "set_id"))
            level = open_.filter(F.col("n") > leaf)
            # two sets that may have no shared token left besides the path meet here for the last time
            leaves.append(level.filter(is_spent & (F.col("n_spent") > 1)).select(F.xxhash64("path", F.lit("spent")).alias("path"), F.col("n_spent").alias("n"), "set_id"))
            level = cut_lineage(level.select("path", "n", "set_id", "size", "rest"))
        pairs = _verified(reduce(DataFrame.unionByName, leaves), sets, threshold, block)
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _verified(leaves: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Exact similarity of the pairs within leaves (path, n, set_id).

    The join goes by (path, block pair); a node of up to ``block`` sets is one
    block. Sizes and 64-bit sketches discard nearly all pairs before any array is
    touched: sets with similarity t differ in at most (1-t)/(1+t) of their joint
    size, and every bit that differs between the sketches needs a token that differs.
    """
    rows = leaves.join(sets.select("set_id", "tokens", F.size("tokens").alias("size"), signature(F.col("tokens")).alias("bits")), "set_id")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    left = rows.select("path", "set_id", "tokens", "size", "bits", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = rows.select("path", F.col("set_id").alias("set_2"), F.col("tokens").alias("tokens_2"), F.col("size").alias("size_2"), F.col("bits").alias("bits_2"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    joint = F.col("size") + F.col("size_2")
    near = (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_2"))) <= F.floor(joint * ((1 - threshold) / (1 + threshold)) + 1e-9)) & (
        F.least("size", "size_2") >= F.greatest("size", "size_2") * threshold - 1e-9
    )
    differs = F.when(F.col("i") == F.col("j"), F.col("set_id") < F.col("set_2")).otherwise(F.lit(True))
    met = left.hint("shuffle_hash").join(right, ["path", "i", "j"]).filter(differs & near)
    shared = F.size(F.array_intersect("tokens", "tokens_2"))
    scored = met.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (joint - F.col("shared")))
    return scored.filter(F.col("similarity") >= threshold - 1e-9).select(F.least("set_id", "set_2").alias("set_a"), F.greatest("set_id", "set_2").alias("set_b"), "similarity").distinct()


def similar_records(records: DataFrame, *, record: str, tokens: str, threshold: float, least_size: int = 1, **options) -> DataFrame:
    """Pairs of different records with similar sets: ``record_a`` < ``record_b``, ``similarity``.

    Null tokens, token order and repetition don't count; records with a null id
    or with fewer than ``least_size`` tokens have no pairs; a record id with
    several sets is compared by each, and the highest similarity counts. Equal
    sets have similarity 1. Extra columns are ignored. An empty table gives an
    empty result. The result is as large as its groups of equal sets make it; use
    :func:`similar_classes` for a result that grows with the records.
    """
    sets, members = (cut_lineage(x) for x in distinct_sets(records, record=record, tokens=tokens, least_size=least_size))
    pairs = similar_sets(sets, threshold=threshold, **options)
    a = members.select(F.col("set_id").alias("set_a"), F.col("record").alias("a"))
    b = members.select(F.col("set_id").alias("set_b"), F.col("record").alias("b"))
    across = pairs.join(a, "set_a").join(b, "set_b").select("a", "b", "similarity")
    within = a.join(b, a["set_a"] == b["set_b"]).filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within).filter("a != b")
    return both.groupBy(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b")).agg(F.max("similarity").alias("similarity"))


def similar_classes(records: DataFrame, *, record: str, tokens: str, threshold: float, least_size: int = 1, **options) -> DataFrame:
    """One row per record: ``record``, ``class_id`` (of its set) and ``links``.

    ``links`` is the number of other records whose sets reach the threshold,
    equal ones included. No pair of records is formed.
    """
    sets, members = (cut_lineage(x) for x in distinct_sets(records, record=record, tokens=tokens, least_size=least_size))
    pairs = similar_sets(sets, threshold=threshold, **options)
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("set_a").alias("set_id"), F.col("set_b").alias("other")).unionByName(pairs.select(F.col("set_b").alias("set_id"), F.col("set_a").alias("other")))
    linked = both.join(sizes.select(F.col("set_id").alias("other"), "n"), "other").groupBy("set_id").agg(F.sum("n").alias("far"))
    return (
        members.join(sizes, "set_id")
        .join(linked, "set_id", "left")
        .select("record", F.lower(F.hex("set_id")).alias("class_id"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    )
