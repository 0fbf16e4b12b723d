"""Reachability, ranks and medians, charges in formulas, and lookups."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vicinage.functions.chemistry import formula_counts
from vicinage.operators.column_profile import FieldRule, LoadKeys, profile_issues, profile_loads
from vicinage.operators.ranks import counted_below, medians
from vicinage.operators.reachability import precheck, reachability
from vicinage.operators.universe import resolve

RECORDS = "jid string, formula string, composition_family string, spacegroup_number int, crystal_system_code int, read int"


def test_reachability_and_precheck(spark):
    rows = [("a", "Fe2O3", "oxide", 167, 5, 1), ("b", "Fe4O6", "oxide", 160, 5, 1), ("c", "FeO", "oxide", 225, 7, 1), ("d", "Fe", "elemental", 229, 7, 1), ("e", "NaCl", "halide", 225, 7, 1), ("f", "FeAl", "intermetallic", None, None, 1), ("g", None, None, None, None, 1), ("h", "", "oxide", 1, 1, 1)]
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("f", "e"), ("f", "a"), ("a", "g"), ("h", "a"), ("a", "absent"), (None, "a")]
    reached = reachability(spark.createDataFrame(pairs, "jid_a string, jid_b string"), spark.createDataFrame(rows, RECORDS))
    got = {(r["jid_a"], r["jid_b"]): r for r in reached.collect()}
    assert set(got) == {p for p in pairs if None not in p and "absent" not in p}
    assert got["a", "b"]["same_reduced_formula"] and got["a", "b"]["chemical_score"] == 1.0 and got["a", "b"]["structural_score"] == pytest.approx(0.55) and not got["a", "b"]["hard_reject"]
    assert got["a", "c"]["reasons"][0] == "same_chemical_system" and got["a", "c"]["chemical_score"] == pytest.approx(0.95)
    assert got["a", "d"]["hard_reject"] and "compound_to_elemental_jump" in got["a", "d"]["reasons"]
    assert got["f", "e"]["hard_reject"] and "cross_bonding_regime_jump" in got["f", "e"]["reasons"]
    assert not got["f", "a"]["hard_reject"] and got["f", "a"]["element_jaccard"] == pytest.approx(1 / 3)
    assert all(got[p]["reasons"] == ["composition_parse_failure"] and got[p]["reachability_score"] == 0 for p in (("a", "g"), ("h", "a")))
    screened = spark.createDataFrame([("a", "b", 6, 0.5, 0.6, 0.9), ("a", "c", 6, 0.1, 0.6, 0.9), ("a", "d", 6, 0.5, 0.6, 0.9)], "jid_a string, jid_b string, feature_count long, mean_delta double, topk_delta double, max_delta double")
    checked = {(r["jid_a"], r["jid_b"]): r for r in precheck(reached, screened).collect()}
    assert checked["a", "b"]["passes"] and not checked["a", "c"]["passes"] and checked["a", "c"]["reasons"] == ["low_mean_standardized_delta"]
    assert checked["a", "d"]["reasons"] == ["reachability_hard_reject"] and len(checked["f", "a"]["reasons"]) == 4


def test_positions_and_medians(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0.5, rng.random(), float(rng.randrange(3))])) for k in "ab" for _ in range(rng.choice([60, 61]))] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: statistics.median(v for q, v in rows if q == k and v is not None) for k in "ab"}
    assert {r["k"]: r["median"] for r in medians(df, "k", "v").collect()} == pytest.approx(want)
    counts = df.filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    values = [v for _, v in rows if v is not None]
    assert all(r["below"] == sum(v < r["v"] for v in values) for r in counted_below(counts, "v", "n").collect())
    assert counted_below(counts.limit(0), "v", "n").count() == 0


def test_charges_are_no_counts(spark):
    df = spark.createDataFrame([("Fe3+",), ("Fe2O3^-",), ("Na +",), ("Fe O 2",), (None,)], "f string")
    assert [r[0] for r in df.select(formula_counts(F.col("f"))).collect()] == [{"Fe": 3.0}, {"Fe": 2.0, "O": 3.0}, {"Na": 1.0}, {"Fe": 1.0, "O": 2.0}, None]


def test_lookup_names_what_is_absent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "jid string, v int")
    assert [r["v"] for r in resolve(base, spark.createDataFrame([("b",), (None,), ("b",)], "jid string")).collect()] == [2]
    with pytest.raises(KeyError, match="zz"):
        resolve(base, spark.createDataFrame([("zz",)], "jid string"))
    assert resolve(base, spark.createDataFrame([("zz",)], "jid string"), strict=False).count() == 0


def test_profile_counts_values_and_masks_decide(spark):
    keys = LoadKeys("load", "part", "series", "no")
    words = ["alpha", "Beta", "gamma", "Delta", "eps", "Zeta"]
    rows = [("l1", "p", 1, 1, w, "Fe-O", "2024-01-01") for w in words] + [("l1", "p", 1, 1, None, v, None) for v in ("FE-O", "Fe O", "O-Fe", "Ünd", "")]
    df = spark.createDataFrame(rows, "load string, part string, series int, no int, word string, system string, at string").withColumn("at", F.col("at").cast("timestamp"))
    for distribution in (True, False):
        rules = {"word": FieldRule(distribution=distribution), "system": FieldRule(masks="<?A[A<>-]*", pattern="[A-Z][a-z]?(?:-[A-Z][a-z]?)*", sorted_by="-"), "at": FieldRule()}
        got = {r["field"]: r for r in profile_loads(df, keys, rules).collect()}
        assert got["word"]["distinct_values"] == 6 and got["word"]["missing_count"] == 5 and got["word"]["low_text"] == "Beta"
        # a run of capitals, a blank, a wrong order and a letter beyond ASCII
        assert got["system"]["bad_format"] == 4 and got["system"]["missing_count"] == 1 and got["at"]["low"] is None
    found = {(r["field"], r["issue"]) for r in profile_issues(df, keys, rules).collect()}
    assert found == {("system", "format")}
