"""Column profile and packed fields."""

import datetime as dt

from vicinage.operators.column_profile import FieldRule, LoadKeys, profile_issues, profile_loads, value_mask
from vicinage.operators.packed_fields import MAX_SKELETONS, folded_skeleton, split_packed, split_tables
from vicinage.plans.quality_queries import POOL_RULES

CELLS = {
    "a;b": ["a", "b"], " a ; ;b;; ": ["a", "b"], "a, b|c/d\ne\r\nf\tg": list("abcdefg"), '"x; y";z': ["x; y", "z"], "'it''s, so'|w": ["it's, so", "w"], '"""so-called"" bridge"': ['"so-called" bridge'],
    "['p', 'q r', \"s, t\"]": ["p", "q r", "s, t"], "[]": [], "[ ]": [], "": [], "  ": [], ";": [], None: [], "one (n=2): x-y": ["one (n=2): x-y"], "a [note]; b": ["a [note]", "b"], "[a]; [b]": ["[a]", "[b]"], "[a, a, a]": ["a", "a", "a"],
    "reviewer's; x": ["reviewer's", "x"], '"";b': ["b"], "\ta ; b\t": ["a", "b"], '"a"\t"b; c"\t': ["a", "b; c"], "x" * 50_000 + ";y": ["x" * 50_000, "y"], '"' + "q;" * 30_000 + '"|z': ["q;" * 30_000, "z"],
}


def test_cells(spark):
    keys = list(CELLS)
    df = spark.createDataFrame([(i, c, "clash", 1) for i, c in enumerate(keys)], "record_id bigint, cell string, field string, item_no int")
    got = {}
    for r in split_packed(df, ["record_id"], ["cell"]).orderBy("record_id", "item_no").collect():
        assert r["field"] == "cell"
        got.setdefault(r["record_id"], []).append(r["item_text"])
        assert r["item_no"] == len(got[r["record_id"]])
    assert {keys[i]: v for i, v in got.items()} == {c: v for c, v in CELLS.items() if v}


def test_rules_are_bounded_and_rows_repeat(spark):
    df = spark.createDataFrame([(None, "a;b"), (None, "a;b"), (3, "c")], "k int, cell string")
    assert split_packed(df, ["k"], ["cell"]).count() == 5
    cells = spark.createDataFrame([(c,) for c in CELLS if c], "c string")
    assert cells.select(folded_skeleton(cells["c"])).distinct().count() <= MAX_SKELETONS == 1024
    both = split_tables([(df, ["k"], ["cell"]), (df.limit(0), ["k"], ["cell"])])
    assert both.count() == 5


def test_masks(spark):
    df = spark.createDataFrame([("JVASP-123",), ("Li-Mn-O",), ("Br7Mn6O7",), ("abc  d",), ("",), ("Ä1é",)], "v string")
    masks = [r[0] for r in df.select(value_mask(df["v"])).collect()]
    assert masks[0] == "A-9" and masks[1] == "<A->A" and masks[4] == "" and masks[3] == "a a"


KEYS = LoadKeys("load_id", "part", "series", "no")
RULES = {"name": FieldRule(pattern="[A-Z][a-z]*"), "parts": FieldRule(sorted_by="-"), "score": FieldRule(low=0, high=1), "kind": FieldRule(distribution=True), "flag": FieldRule()}
SCHEMA = "load_id string, part string, series int, no int, name string, parts string, score double, kind string, flag boolean, field string, issue string"


def loads(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def rows_of(load, series, no, n=10, **changes):
    base = {"name": "Abc", "parts": "a-b", "score": 0.5, "kind": "x", "flag": True}
    return [(load, "p", series, no, *({**base, **{k: v(i) if callable(v) else v for k, v in changes.items()}}[c] for c in base)) for i in range(n)]


def issues(df, reports=None):
    return {(r["load_id"], r["field"], r["issue"]) for r in profile_issues(df, KEYS, RULES, reports).collect()}


def test_issues(spark):
    rows = rows_of("a", 1, 1) + rows_of("b", 1, 5, name=lambda i: [" NaN ", "Abc"][i > 2], kind=lambda i: "x" if i < 5 else "y") + rows_of("c", 1, 9, score=lambda i: float("nan") if i else 1.5, parts="b-a", name="Abc\n")
    rows += rows_of("z", 2, 7, kind=lambda i: None, flag=None) + rows_of(None, 1, 6) + rows_of("w", None, 2)
    got = issues(loads(spark, rows))
    assert got == {("b", "name", "jump"), ("b", "kind", "shift"), ("c", "name", "jump"), ("c", "kind", "shift"), ("c", "score", "range"), ("c", "score", "jump"), ("c", "parts", "format"), ("c", "name", "format")}


def test_limits_are_met_exactly(spark):
    # 2 of 10 missing after none is no jump; shares 0.35 apart are no shift
    rows = rows_of("a", 1, 1, n=20) + rows_of("b", 1, 2, n=20, name=lambda i: "None" if i < 4 else "Abc", kind=lambda i: "y" if i < 7 else "x")
    assert issues(loads(spark, rows)) == set()


def test_reports(spark):
    rows = loads(spark, rows_of("a", 1, 1, name=lambda i: "" if i < 3 else "Abc"))
    day = lambda d: dt.datetime(2025, 1, d)
    said = [("a", "p", "name", 2, 0.2, day(1)), ("a", "p", "name", 3, 0.3, day(2)), ("a", "p", "score", None, 0.0, day(1)), ("a", "p", "kind", 0, 0.002, day(1)), ("a", "p", "flag", 0, 0.0009, day(1)), ("q", "p", "flag", 9, 0.9, day(1))]
    reports = spark.createDataFrame(said, "load_id string, part string, field string, missing_count int, missing_rate double, reported_at timestamp")
    assert issues(rows, reports) == {("a", "score", "report"), ("a", "kind", "report")}


def test_profile_of_loads(spark):
    rows = rows_of("a", 1, 1, name=lambda i: "Abc" if i else "A-b") + rows_of("b", 1, 2, name="x1")
    got = {(r["load_id"], r["field"]): r for r in profile_loads(loads(spark, rows), KEYS, RULES).collect()}
    assert len(got) == 10 and got["b", "name"]["mask_divergence"] == 1.0 and got["a", "name"]["mask_divergence"] is None
    assert got["a", "score"]["low"] == 0.5 and got["b", "name"]["bad_format"] == 10 and got["a", "name"]["distinct_values"] == 2
    assert profile_loads(loads(spark, []), KEYS, RULES).count() == 0 and issues(loads(spark, [])) == set()


def test_distinct_values_of_a_distribution_field(spark):
    # seven values in two masks, one of them repeated, and one missing
    kinds = ["ab", "cd", "ef", "gh", "ij", "k1", "k2", "ab", None]
    df = loads(spark, rows_of("a", 1, 1, n=9, kind=lambda i: kinds[i]))
    got = {r["field"]: r["distinct_values"] for r in profile_loads(df, KEYS, RULES).collect()}
    assert got["kind"] == 7 and got["name"] == 1


def test_rules_of_the_pools():
    assert len(POOL_RULES) == 15
