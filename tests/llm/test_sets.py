"""Set join and varied subset."""

import random

import numpy as np
import pytest

from vicinage.llm.queries import element_symbols
from vicinage.llm.set_join import similar_classes, similar_records, trees_for
from vicinage.llm.varied_subset import balanced_targets, class_quotas, varied_subset


def brute(sets, threshold, least):
    out = {}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if len(x) >= least and len(y) >= least:
                s = len(x & y) / len(x | y)
                if s >= threshold - 1e-12:
                    out[(a, b)] = round(s, 9)
    return out


def random_sets(seed, n, tokens, longest):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(tokens)]
    sets = {}
    for i in range(n):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(list(sets.values())))
            if base and rng.random() < 0.7:
                base.discard(rng.choice(sorted(base)))
            if rng.random() < 0.7:
                base.add(f"t{rng.randrange(tokens)}")
        else:
            base = set(f"t{k}" for k in rng.choices(range(tokens), weights, k=rng.randrange(1, longest)))
        sets[f"r{i:04d}"] = base
    return sets


@pytest.mark.parametrize("threshold,least,leaf", [(0.8, 1, 10), (0.6, 4, 16)])
def test_join_against_brute_force(spark, threshold, least, leaf):
    sets = random_sets(3, 200, 40, 14)
    rows = [(r, sorted(s, key=lambda t: hash((r, t))) + sorted(s)[:1] + [None], "clash") for r, s in sets.items()]
    df = spark.createDataFrame(rows, "id string, tags array<string>, set_id string")
    got = similar_records(df, record="id", tokens="tags", threshold=threshold, least_size=least, leaf=leaf)
    assert {(r["record_a"], r["record_b"]): round(r["similarity"], 9) for r in got.collect()} == brute(sets, threshold, least)


def test_classes_count_links(spark):
    sets = random_sets(4, 80, 20, 9)
    df = spark.createDataFrame([(r, sorted(s)) for r, s in sets.items()], "id string, tags array<string>")
    links = {r["record"]: r["links"] for r in similar_classes(df, record="id", tokens="tags", threshold=0.8, leaf=8).collect()}
    want = dict.fromkeys((r for r, s in sets.items() if s), 0)
    for a, b in brute(sets, 0.8, 1):
        want[a] += 1
        want[b] += 1
    assert links == want


def test_hot_set_and_odd_rows(spark):
    rows = [(f"h{i}", ["a", "b", "c"]) for i in range(400)] + [("n", None), ("e", []), (None, ["a", "b", "c"]), ("x", ["a", "b", "c", "d"])]
    df = spark.createDataFrame(rows, "id string, tags array<string>")
    links = {r["record"]: r["links"] for r in similar_classes(df, record="id", tokens="tags", threshold=0.75, leaf=4).collect()}
    assert links["x"] == 400 and links["h1"] == 400 and set(links) == {f"h{i}" for i in range(400)} | {"x"}
    empty = spark.createDataFrame([], "id string, tags array<string>")
    assert similar_records(empty, record="id", tokens="tags", threshold=0.8).count() == 0


def test_sampled_trees_reach_their_recall(spark):
    sets = random_sets(6, 120, 40, 12)
    df = spark.createDataFrame([(r, sorted(s)) for r, s in sets.items()], "id string, tags array<string>")
    got = {(r["record_a"], r["record_b"]) for r in similar_records(df, record="id", tokens="tags", threshold=0.8, leaf=30, follow=0.5, sampled_recall=0.9).collect()}
    want = set(brute(sets, 0.8, 1))
    assert got <= want and len(got) >= 0.9 * len(want)
    assert trees_for(0.9, 0.8, 1.0, 3) == 1 < trees_for(0.9, 0.8, 0.5, 3)


def test_symbols(spark):
    df = spark.createDataFrame([(["o", " O", "O2+", "O(III)", "O2-", "MN\t", " li", None, "", "  ", "S+", "Fe(iv) "],)], "e array<string>")
    assert df.select(element_symbols(df["e"])).first()[0] == ["O", "Mn", "Li", "S", "Fe"]


def test_quotas_are_optimal_on_small_cases():
    # two families, fine values with one record each: balance decides
    flow = class_quotas(np.array([[1, 0], [0, 1]]), np.array([10, 30]), 16)
    assert flow.tolist() == [[8, 0], [0, 8]]
    # records of one fine value cost ever more, so the many single ones come first
    flow = class_quotas(np.array([[100], [1]]), np.array([1, 9]), 10)
    assert flow.tolist() == [[1], [9]]
    # a mixed class is moved to the family that is short
    flow = class_quotas(np.array([[1, 0], [1, 1]]), np.array([5, 5]), 10)
    assert flow.sum() == 10 and flow[:, 1].sum() == 5
    assert balanced_targets(np.array([2, 100, 100]), 62).tolist() == [2, 30, 30]


def cost_of(flow, multiplicity, target, steps=8):
    """Cost of a flow by the same convex costs, counted record by record."""
    total = 0
    for c, m in enumerate(multiplicity):
        for i in range(int(flow[c].sum())):
            total += 2 * (2 * (i // m) + 1)
    for f, t in enumerate(target):
        part = max(1, -(-int(t) // steps))
        total += sum(i // part + 1 for i in range(max(0, int(flow[:, f].sum() - t))))
    return total


def test_quotas_cost_no_more_than_any_other_choice():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(25):
        capacity = rng.integers(0, 3, (3, 2))
        multiplicity = rng.integers(1, 3, 3)
        room = capacity * multiplicity[:, None]
        size = int(room.sum() * rng.uniform(0.3, 0.9))
        flow = class_quotas(capacity, multiplicity, size)
        assert flow.sum() == size and (flow <= room).all() and (flow >= 0).all()
        target = balanced_targets(room.sum(0), size)
        every = itertools.product(*[range(v + 1) for v in room.flatten()])
        best = min(cost_of(np.array(e).reshape(room.shape), multiplicity, target) for e in every if sum(e) == size)
        assert cost_of(flow, multiplicity, target) == best


def test_quotas_of_many_classes_take_few_steps():
    import time

    rng = np.random.default_rng(3)
    capacity = rng.integers(0, 400, (4096, 12)) * (rng.random((4096, 12)) < 0.3)
    began = time.time()
    flow = class_quotas(capacity, np.ones(4096, dtype=np.int64), 1_000_000)
    assert flow.sum() == 1_000_000 and (flow <= capacity).all()
    assert time.time() - began < 60


def test_planted_varieties_are_covered(spark):
    # forty families of unlike size; a subset holds nearly equal numbers of each, whatever their share
    rows = [(f"r{f}_{i}", f"S{f}_{i % 60}", f"fam{f:02d}") for f in range(40) for i in range(60 + 20 * f)]
    for size in (200, 800):
        got = subset(spark, rows, size)
        counts = [sum(g[2] == f"fam{f:02d}" for g in got) for f in range(40)]
        assert len(got) == size and max(counts) - min(counts) <= 1
        assert len({g[1] for g in got}) == size
    assert len(subset(spark, rows, 800, max_classes=50)) == 800
    with pytest.raises(ValueError, match="coarse"):
        subset(spark, [(f"i{k}", "S", f"f{k}") for k in range(300)], 5)


def subset(spark, rows, size, **kw):
    df = spark.createDataFrame([(i, s, f, "clash") for i, s, f in rows], "id string, system string, family string, fine string")
    return [(r["id"], r["fine"], r["coarse"]) for r in varied_subset(df, item="id", fine="system", coarse="family", size=size, **kw).collect()]


def test_number_of_classes_changes_nothing(spark):
    # sixty fine values of unlike counts, so sixty classes
    rows = [(f"r{k}_{i}", f"S{k}", f"fam{k % 3}") for k in range(1, 61) for i in range(k)]
    few = sorted(subset(spark, rows, 900, max_classes=10))
    assert len(few) == 900 and few == sorted(subset(spark, rows, 900))
    taken = np.array([[sum(g[1] == f"S{k}" for g in few) * (k % 3 == f) for f in range(3)] for k in range(1, 61)])
    capacity = np.array([[k * (k % 3 == f) for f in range(3)] for k in range(1, 61)])
    one = np.ones(60, dtype=np.int64)
    target = balanced_targets(capacity.sum(0), 900)
    assert cost_of(taken, one, target) == cost_of(class_quotas(capacity, one, 900), one, target)


def test_counts_are_cut_only_where_quotas_do_not_reach(spark):
    # the only fine value of a family is worth more records than an even spread would take of it
    rows = [(f"a{f}_{i}", f"A{f}", f"rare{f}") for f in range(7) for i in range(300)] + [(f"b{i}", f"B{i}", "many") for i in range(2000)]
    capacity = np.concatenate([np.eye(8, dtype=np.int64)[:1], 300 * np.eye(8, dtype=np.int64)[1:]])
    want = class_quotas(capacity, np.array([2000] + [1] * 7), 800)
    got = subset(spark, rows, 800)
    assert want[1, 1] > 2 and [sum(g[2] == f"rare{f}" for g in got) for f in range(7)] == [want[f, f] for f in range(1, 8)]


def test_subset_covers_and_is_exact_in_size(spark):
    rows = [(f"hot{i}", "S0", "oxide") for i in range(600)] + [(f"r{i}", f"S{i % 150 + 1}", ["oxide", "halide", None][i % 3]) for i in range(300)] + [("r0", "S1", "oxide"), (None, "S1", "oxide")]
    got = subset(spark, rows, 120)
    assert len(got) == len({g[0] for g in got}) == 120
    assert sum(g[1] == "S0" for g in got) <= 2
    families = {f: sum(g[2] == f for g in got) for f in ("oxide", "halide", None)}
    assert max(families.values()) - min(families.values()) <= 12
    assert sorted(got) == sorted(subset(spark, list(reversed(rows)), 120)) if None not in {g[2] for g in got} else {g[0] for g in got} == {g[0] for g in subset(spark, list(reversed(rows)), 120)}


def test_subset_larger_than_its_varieties(spark):
    rows = [(f"a{i}", "S0", "oxide") for i in range(50)] + [(f"b{i}", "S1", "halide") for i in range(5)]
    got = subset(spark, rows, 30)
    assert len(got) == 30 and sum(g[1] == "S1" for g in got) == 5
    assert len(subset(spark, rows, 500)) == 55 and subset(spark, rows, 0) == [] and subset(spark, [], 5) == []
    assert len(subset(spark, rows, 0.2)) == 11


@pytest.mark.parametrize("n", [400, 1200])
def test_near_copies_stay_in_proportion(spark, n, monkeypatch):
    from vicinage.llm import set_join

    # every two sets share 19 of 21 tokens, so every pair is one of the result
    df = spark.createDataFrame([(f"r{i:05d}", [f"t{k}" for k in range(19)] + [f"own{i}"]) for i in range(n)], "id string, tags array<string>")
    rows = []
    verified = set_join._verified
    monkeypatch.setattr(set_join, "_verified", lambda leaves, *a: rows.append(leaves.count()) or verified(leaves, *a))
    links = similar_classes(df, record="id", tokens="tags", threshold=0.8, leaf=256).agg({"links": "min", "*": "count"}).first()
    assert links["min(links)"] == n - 1 and links["count(1)"] == n
    # a set is compared in one node, that is once
    assert rows == [n]


def test_near_copies_among_others(spark, monkeypatch):
    from vicinage.llm import set_join

    rng = random.Random(8)
    sets = {f"c{i:04d}": {f"t{k}" for k in range(19)} | {f"own{i}"} for i in range(300)} | {f"x{i:04d}": {f"w{rng.randrange(4000)}" for _ in range(20)} for i in range(600)}
    df = spark.createDataFrame([(r, sorted(s)) for r, s in sets.items()], "id string, tags array<string>")
    rows = []
    verified = set_join._verified
    monkeypatch.setattr(set_join, "_verified", lambda leaves, *a: rows.append(leaves.count()) or verified(leaves, *a))
    links = similar_classes(df, record="id", tokens="tags", threshold=0.8, leaf=64).filter("links > 0").agg({"links": "min", "*": "count"}).first()
    assert links["min(links)"] == 299 and links["count(1)"] == 300
    # four of the five tokens that a near-copy follows are shared by all
    assert rows[0] <= 5 * len(sets)
