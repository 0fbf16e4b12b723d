"""Mixture clusters, exact linkage and bounded heaps."""

import collections
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.llm.mixture_clusters import describe_clusters, fit_mixture, linked_groups, mixture_clusters
from vicinage.llm.top_n import top_n_per_group

SCHEMA = "case string, x double, y double, item string, cluster_id int"


def table(spark, rows):
    return spark.createDataFrame([(c, x, y, "clash", 7) for c, x, y in rows], SCHEMA)


def brute_groups(points, tolerance, least):
    parent = {c: c for c, _, _ in points}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, (a, x, y) in enumerate(points):
        for b, u, v in points[:i]:
            if round(abs(x - u), 9) <= tolerance and round(abs(y - v), 9) <= tolerance:
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for c, _, _ in points:
        groups[root(c)].append(c)
    return {(c, min(g)) for g in groups.values() if len(g) >= least for c in g}


def test_linkage_against_brute_force(spark):
    rng = random.Random(1)
    points = [(f"c{i}", round(rng.uniform(0, 0.06), 6), round(rng.uniform(0, 0.06), 6)) for i in range(700)]
    # a chain across many tiles, cells filled by copies, and values on cell borders
    points += [(f"chain{i}", round(0.2 + i * 0.0004, 6), 0.5) for i in range(120)]
    points += [(f"same{i}", 0.9, 0.9) for i in range(300)]
    points += [("edge0", 0.7, 0.7), ("edge1", 0.7004, 0.7004), ("edge2", 0.700801, 0.7008)]
    assigned, mixture = mixture_clusters(table(spark, points), item="case", features=("x", "y"), lowest=0, highest=1, components=(1, 4, 8))
    assert mixture.size > 1
    got = {(r["item"], r["group_key"]) for r in linked_groups(assigned, tolerance=0.0004, least_size=2).collect()}
    assert got == brute_groups(points, 0.0004, 2)


def test_unusable_rows_repeats_and_empty(spark):
    rows = [("a", 0.5, 0.5), ("a", 0.5, 0.5), ("b", None, 0.5), ("c", float("nan"), 0.5), ("d", 1.5, 0.5), (None, 0.5, 0.5), ("e", float("inf"), 0.1)]
    assigned, mixture = mixture_clusters(table(spark, rows), item="case", features=("x", "y"), lowest=0, highest=1)
    assert [r["item"] for r in assigned.collect()] == ["a"] and mixture is not None
    nothing, none = mixture_clusters(table(spark, []), item="case", features=("x", "y"))
    assert none is None and nothing.count() == 0
    assert linked_groups(nothing, tolerance=0.0004).count() == 0


def test_mixture_finds_separate_blobs(spark):
    rng = np.random.default_rng(0)
    centres = [(0.2, 0.2), (0.8, 0.2), (0.5, 0.8)]
    rows = [(f"p{k}_{i}", float(a), float(b)) for k, (cx, cy) in enumerate(centres) for i, (a, b) in enumerate(rng.normal((cx, cy), 0.02, (200, 2)))]
    assigned, mixture = mixture_clusters(table(spark, rows), item="case", features=("x", "y"), components=(1, 2, 3, 4, 6))
    assert mixture.size == 3 and min(mixture.criterion, key=mixture.criterion.get) == 3
    by_blob = collections.defaultdict(set)
    for r in assigned.collect():
        by_blob[r["item"].split("_")[0]].add(r["cluster_id"])
    assert all(len(v) == 1 for v in by_blob.values()) and len(set.union(*by_blob.values())) == 3
    described = describe_clusters(assigned).collect()
    assert sorted(r["cluster_size"] for r in described) == [200, 200, 200]
    assert all(r["typical_members"][0] == r["representative"] for r in described)


def test_mixture_of_equal_points(spark):
    assert fit_mixture(table(spark, [("a", 0.1, 0.2)] * 5), ("x", "y")).size == 1


def many_blobs(spark, side=7):
    rng = np.random.default_rng(1)
    return table(spark, [(f"p{x}_{y}_{i}", 0.05 + 0.13 * x + float(a), 0.05 + 0.13 * y + float(b)) for x in range(side) for y in range(side) for i, (a, b) in enumerate(rng.normal(0, 0.0005, (30, 2)))])


def test_components_go_on_until_the_criterion_rises(spark):
    df = many_blobs(spark)
    mixture = fit_mixture(df, ("x", "y"))
    best = min(mixture.criterion, key=mixture.criterion.get)
    # 49 blobs, beyond the 32 components of the first numbers
    assert mixture.size == best >= 48 and mixture.settled
    assert all(mixture.criterion[k] > mixture.criterion[best] for k in mixture.criterion if k > best)


@pytest.mark.parametrize("dimensions,spread", [(7, 0.02), (15, 0.02), (15, 0.2)])
def test_blobs_of_many_dimensions(spark, dimensions, spread):
    rng = np.random.default_rng(dimensions)
    centres = rng.uniform(0, 1, (6, dimensions))
    rows = [(f"p{k}_{i}", *map(float, x)) for k in range(6) for i, x in enumerate(rng.normal(centres[k], spread * 0.2, (150, dimensions)))]
    names = [f"v{i}" for i in range(dimensions)]
    df = spark.createDataFrame(rows, "case string, " + ", ".join(f"{n} double" for n in names))
    assigned, mixture = mixture_clusters(df, item="case", features=names, components=(1, 2, 4, 6, 8))
    assert mixture.size == 6
    found = collections.defaultdict(collections.Counter)
    for r in assigned.collect():
        found[r["item"].split("_")[0]][r["cluster_id"]] += 1
    assert all(max(c.values()) >= 0.98 * 150 for c in found.values()) and len({c.most_common(1)[0][0] for c in found.values()}) == 6


def test_few_cells_tell_blobs_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{k}_{i}", *map(float, x)) for k in range(4) for i, x in enumerate(rng.normal([k, 2 * k % 3, 0], 0.03, (500, 3)))]
    df = spark.createDataFrame(rows, "case string, a double, b double, c double")
    with pytest.warns(UserWarning, match="wide"):
        mixture = fit_mixture(df, ("a", "b", "c"), max_cells=60, components=(1, 2, 3, 4, 5, 6))
    assert mixture.size == 4


def test_far_rows_leave_the_rest_as_it_is(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{k}_{i}", float(a), float(b)) for k in range(3) for i, (a, b) in enumerate(rng.normal((k, -k), 0.05, (1000, 2)))]
    rows += [(f"far_{i}", 1e6 + i, -1e6) for i in range(3)]
    assigned, mixture = mixture_clusters(table(spark, rows), item="case", features=("x", "y"), components=(1, 2, 3, 4, 5, 6))
    groups = collections.defaultdict(collections.Counter)
    for r in assigned.collect():
        groups[r["item"].split("_")[0]][r["cluster_id"]] += 1
    assert mixture.size >= 3 and len({g.most_common(1)[0][0] for g in groups.values()}) >= 3
    assert all(g.most_common(1)[0][1] >= 0.9 * g.total() for g in groups.values())


def test_a_bound_that_is_hit_is_told(spark):
    df = many_blobs(spark)
    with pytest.raises(ValueError, match="still falls at 16"):
        fit_mixture(df, ("x", "y"), most=16)
    with pytest.warns(UserWarning, match="still falls at 8"):
        assert not fit_mixture(df, ("x", "y"), components=(4, 8)).settled


def test_more_than_a_thousand_components(spark):
    blob, side = F.col("id") % 1331, 11
    jitter = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1e6) for i in range(3)]
    axes = [blob % side, F.floor(blob / side) % side, F.floor(blob / side**2)]
    df = spark.range(1331 * 60).select(*[(a / 10.0 + j).alias(n) for n, a, j in zip("abc", axes, jitter)])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixture = fit_mixture(df, ("a", "b", "c"), starts=1)
    assert 1024 < mixture.size == min(mixture.criterion, key=mixture.criterion.get)


def test_links_of_clusters_of_great_numbers(spark):
    # one group whose items stand in two clusters, and another
    rows = [(f"a{i}", 0.1 + i * 1e-4, 0.2, 200_000 + 4096 * (i % 2)) for i in range(9)] + [(f"b{i}", 0.5, 0.5, 4096) for i in range(3)] + [("c", 0.9, 0.9, 0), ("d", 0.9, 0.9, 4096)]
    assigned = spark.createDataFrame(rows, "item string, f0 double, f1 double, cluster_id int")
    got = {(r["item"], r["group_key"], r["group_size"]) for r in linked_groups(assigned, tolerance=0.0004).collect()}
    assert got == {(f"a{i}", "a0", 9) for i in range(9)} | {(f"b{i}", "b0", 3) for i in range(3)} | {("c", "c", 2), ("d", "c", 2)}


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), f"i{rng.randrange(40)}", rng.choice([None, float("nan"), -1.0, 2.0, 0.5, 0.5, round(rng.random(), 2)])) for _ in range(3000)]
    rows += [("hot", f"n{i}", 0.25) for i in range(5000)] + [("d", "d", 0.9), ("d", None, 0.5), (None, "x", 0.5), ("d", "e", -0.0), ("d", "f", 0.0)]
    df = spark.createDataFrame([(g, i, s, 1, "x") for g, i, s in rows], "g string, i string, s double, rank int, __heap string")
    got = {(r["g"], r["i"], r["rank"]) for r in top_n_per_group(df, "g", "i", "s", 5, lowest=0, highest=1, drop_self=True).collect()}
    best = collections.defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and g != i and s is not None and s == s and 0 <= s <= 1:
            best[g][i] = max(best[g].get(i, -1), s)
    want = {(g, i, k + 1) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert got == want


def test_top_n_of_groups_full_of_repeats(spark):
    # the best 40 entries of one group are one item; of another, three items; a third has few entries
    rows = [("a", "x", 0.9)] * 60 + [("a", f"y{i}", 0.1 + i / 100) for i in range(9)] + [("b", f"z{i % 3}", 0.8) for i in range(50)] + [("c", "k", 0.3), ("c", "k", 0.4)]
    df = spark.createDataFrame(rows, "g string, i string, s double").repartition(5)
    got = sorted((r["g"], r["rank"], r["i"], r["score"]) for r in top_n_per_group(df, "g", "i", "s", 5).collect())
    assert got == [("a", 1, "x", 0.9), *[("a", k + 2, f"y{8 - k}", 0.1 + (8 - k) / 100) for k in range(4)], *[("b", k + 1, f"z{k}", 0.8) for k in range(3)], ("c", 1, "k", 0.4)]


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i string, s double")
    assert top_n_per_group(df, "g", "i", "s", 3).columns == ["g", "i", "score", "rank"]
    assert top_n_per_group(df, "g", "i", "s", 3).count() == 0
