"""Operators of the universe, retrieval, evidence and cohort comparison, on small tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.functions import chemistry as C
from vicinage.functions import scalars as S
from vicinage.functions import scores as G
from vicinage.functions import similarity as X
from vicinage.operators import clustering as K
from vicinage.operators import cohort as H
from vicinage.operators import plausibility as P
from vicinage.operators import pool_metrics as M
from vicinage.operators import retrieval as R
from vicinage.operators import roles as Q
from vicinage.operators import universe as U
from vicinage.operators.components import connected_components
from vicinage.session import cut_lineage
from vicinage.sources import external as E
from vicinage.streaming import queries as T


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}")
    return [r[0] for r in df.orderBy("__i").select(column).collect()]


def test_null_semantics(spark):
    words = [("true",), ("Unknown",), ("ICSD-12",), ("0",), (" ",), (None,), ("1.0",), ("n/a",)]
    assert values(spark, S.support_flag(F.col("v")), words, "v string") == [True, None, True, False, None, None, True, None]
    assert values(spark, S.strict_flag(F.col("v")), words, "v string") == [True, False, None, False, None, None, None, None]
    assert values(spark, S.metric_flag(F.col("v")), words, "v string") == [True, None, None, False, None, None, None, None]
    numbers = [(0.5,), (None,), (float("nan"),), (-3.0,), (float("inf"),)]
    assert values(spark, S.clip01(F.col("v")), numbers, "v double") == [0.5, None, None, 0.0, 1.0]
    assert values(spark, S.clip01_or_zero(F.col("v")), numbers, "v double") == [0.5, 0.0, 0.0, 0.0, 1.0]
    assert values(spark, S.number(F.col("v")), numbers, "v double") == [0.5, None, None, -3.0, None]
    assert values(spark, S.number_or(F.col("v")), [("x",), ("2",), (None,)], "v string") == [0.0, 2.0, 0.0]
    assert values(spark, S.slug(F.col("v")), [("../a b//c",), ("..",), (None,)], "v string") == ["a_b_c", "case", "case"]


def test_two_balances_differ(spark):
    row = [(0.4, 0.8), (None, 0.5)]
    assert values(spark, G.balance_by_ratio(F.col("a"), F.col("b")), row, "a double, b double") == [pytest.approx(0.3), None]
    assert values(spark, G.balance_by_gap(F.col("a"), F.col("b")), row, "a double, b double") == [pytest.approx(0.24), 0.0]
    assert values(spark, G.entropy_of([F.col("a"), F.col("b")], zeros_count=True), [(0.5, 0.5), (1.0, 0.0), (None, None)], "a double, b double") == [pytest.approx(1.0), 0.0, None]


FORMULAS = [("SrTiO3", 221, "perovskite_like", "ideal_cubic_perovskite", "ABO3"), ("Fe3O4", 227, "spinel_like", "cubic_mixed_valence_or_inverse_spinel", "AB2O4"), ("LiMn2O4", 62, "spinel_like", "distorted_battery_spinel_derivative", "AB2O4"), ("La2Zr2O7", 1, "pyrochlore_like", "pyrochlore_like_unknown_variant", "A2B2O7"),
            ("ZrO2", 14, "fluorite_related", "monoclinic_fluorite_derivative", "AO2"), ("MoS2", 194, "dichalcogenide_like", "layered_chalcogenide_candidate", "AB2"), ("Ti3SiC2", 194, "max_phase_like", "layered_carbide_nitride_candidate", "AB2C3"), ("MoW3(SeS3)2", 1, "unknown", "unknown", "ABC3D3"), (None, None, "unknown", "unknown", "unknown"), ("Fe4O4", 225, "unknown", "unknown", "AB")]


def test_families(spark):
    df = spark.createDataFrame([(i, f, n, None, None) for i, (f, n, *_) in enumerate(FORMULAS)], "i int, formula string, spacegroup_number int, composition_family string, spacegroup_symbol string")
    for r, (f, _, proto, variant, formula) in zip(C.classify_families(df).orderBy("i").collect(), FORMULAS):
        assert (r["labels"]["prototype_family"], r["labels"]["structure_variant"], r["labels"]["formula_family"]) == (proto, variant, formula), f
    oxide = spark.createDataFrame([("Ti2CO", 1, "oxide", None)], "formula string, spacegroup_number int, composition_family string, spacegroup_symbol string")
    assert C.classify_families(oxide).first()["labels"]["material_family"] == "max_phase_like"


def test_similarities(spark):
    a, b = {"x": 3.0, "y": 1.0}, {"y": 1.0, "z": 2.0}
    schema = "a map<string,double>, b map<string,double>"
    assert values(spark, X.weighted_jaccard(F.col("a"), F.col("b")), [(a, b), ({}, {}), (a, a)], schema) == [pytest.approx(1 / 6), None, 1.0]
    p, q = {"x": 0.75, "y": 0.25, "z": 0.0}, {"x": 0.0, "y": 1 / 3, "z": 2 / 3}
    mid = {k: (p[k] + q[k]) / 2 for k in p}
    js = sum(w[k] / 2 * math.log2(w[k] / mid[k]) for w in (p, q) for k in p if w[k] > 0)
    assert values(spark, X.jensen_shannon(F.col("a"), F.col("b")), [(a, b), ({}, {}), (a, {})], schema) == [pytest.approx(1 - math.sqrt(js)), None, 0.0]
    weights = values(spark, X.rank_weights(F.col("v")), [(["a", "", "b", "a"],)], "v array<string>")[0]
    assert weights == {"a": pytest.approx(1 / math.log2(3)), "b": pytest.approx(1 / math.log2(5))}
    assert values(spark, X.count_similarity(F.col("a"), F.col("b")), [(0, 0), (None, None), (None, 1), (2, 4)], "a int, b int") == [1.0, None, 0.0, 0.5]


def small_universe(spark, n=60, seed=1):
    rng = random.Random(seed)
    names = ["Li", "Mn", "O", "Fe", "S", "Ti", "Sr"]
    rows = []
    for i in range(n):
        symbols = sorted(rng.sample(names, rng.randrange(1, 4)))
        rows.append((f"m{i:03d}", "".join(s + str(rng.randrange(1, 4)) for s in symbols), symbols, rng.randrange(1, 231), rng.choice([None, 0.0, 0.05, 0.3]), rng.choice([None, "true", "icsd"])))
    df = spark.createDataFrame(rows, "jid string, formula string, elements array<string>, spacegroup_number int, energy_above_hull double, known_synthesized string")
    return U.with_families(U.prepare(df))


def greedy(rows, size, quota):
    used, out = {}, []
    for r in rows:
        s = r["chemical_system"] or "UNKNOWN"
        if quota and used.get(s, 0) >= quota:
            continue
        used[s] = used.get(s, 0) + 1
        out.append(r["candidate_id"])
        if len(out) == size:
            break
    return out


def test_pools_against_greedy_scan(spark):
    base = cut_lineage(small_universe(spark))
    queries = cut_lineage(R.query_rows(base.filter("jid < 'm003'")))
    config = R.PoolConfig(quotas=dict.fromkeys(R.POOLS, 2)).with_sizes(same_family=9, adjacent_family=9, boundary_contrast=9, wildcard=6, negative_control=4)
    table = cut_lineage(R.all_pools(base, queries, config))
    pools = table.collect()
    rows = [r.asDict() for r in R.annotate(base, queries, config).withColumns({f"s_{n}": F.round(s, 9) for n, s in R.scores().items()} | {f"e_{n}": e for n, e in R.eligibility(config).items()} | {f"j_{n}": S.stable_fraction(config.seed + R.SEED_OFFSETS[n], F.col("candidate_id")) for n in R.POOLS}).collect()]
    for q in ("m000", "m001", "m002"):
        taken = set()
        for name in R.POOLS:
            mine = [r for r in rows if r["query_id"] == q and (name not in ("wildcard", "negative_control") or r["candidate_id"] not in taken)]
            able = [r for r in mine if r[f"e_{name}"]] or (mine if name == "negative_control" else [])
            order = sorted(able, key=lambda r: (-(r[f"s_{name}"] or 0.0), not r["is_stable_or_known"], -r["element_overlap_count"], r[f"j_{name}"], r["candidate_id"]))
            got = [p["candidate_id"] for p in sorted((p for p in pools if p["query_id"] == q and p["pool_name"] == name), key=lambda p: p["rank_in_pool"])]
            assert got == greedy(order, config.sizes[name], 2), (q, name)
            taken |= set(got)
    independence, overlaps, missing = M.independence(table), M.overlaps(table), M.missing_report(table, ["formula", "band_gap", "nowhere"])
    wide = cut_lineage(Q.by_query(M.metrics(table)))
    concepts = Q.named_concepts(wide, independence, missing).collect()
    scored = Q.role_scores(wide, queries, overlaps, independence, missing).collect()
    assert len(concepts) == len(scored) == 3 and all(0 <= r["hub_score"] <= 1 and r["primary_role"] in ("hub", "boundary", "other") for r in scored)
    assert all(0 <= v <= 1 + 1e-9 for r in concepts for k, v in r.asDict().items() if k != "query_id" and v is not None)


def test_role_score_of_a_known_case(spark):
    # fixed values: metrics of a published case and the two scores reported for it
    pools = {
        "same_family": dict(n_candidates=500, same_composition_family_rate=1.0, same_material_family_rate=0.0, same_formula_family_rate=0.0, same_prototype_family_rate=1.0, same_structure_variant_rate=1.0, stable_fraction=1.0, known_synthesized_rate=1.0, mean_element_overlap_fraction=0.5),
        "boundary_contrast": dict(n_candidates=250, same_formula_family_rate=0.2, same_prototype_family_rate=0.6, same_spacegroup_rate=0.1, same_crystal_system_rate=0.3, same_structure_variant_rate=0.4, mean_symmetry_distance=80.0, spacegroup_number_entropy=0.5, stable_fraction=0.9),
    }
    fields = ["n_candidates", "chemical_system_count", "stable_fraction", "known_synthesized_rate", "mean_symmetry_distance", "mean_element_overlap_fraction", "query_similarity_score", "structural_metadata_similarity_score", "structural_regime_diversity_score", *[f"same_{x}_rate" for x in (*R.FLAGS, "spacegroup", "crystal_system")], *[f"{x}_entropy" for x in M.CATEGORIES]]
    schema = "query_id string, pool_name string, " + ", ".join(f"{f} double" for f in fields)
    metrics = spark.createDataFrame([("q", p, *[float(v[f]) if f in v else None for f in fields]) for p, v in pools.items()], schema)
    queries = spark.createDataFrame([("q", "ABO3", "perovskite_like", "distorted_perovskite", 62)], "query_id string, q_formula_family string, q_prototype_family string, q_structure_variant string, q_spacegroup_number int")
    overlaps = spark.createDataFrame([], "query_id string, pool_a string, pool_b string, shared bigint")
    independence = spark.createDataFrame([("q", 0, 750, 750)], "query_id string, in_several_pools bigint, unique_candidates bigint, entries bigint")
    missing = spark.createDataFrame([("q", "same_family", "x", 0.1)], "query_id string, pool_name string, field string, missing_rate double")
    r = Q.role_scores(Q.by_query(metrics), queries, overlaps, independence, missing).first()
    hub = (0.15 + 0.10 + 0 + 0 + 0.20 + 0.10 + 0.05 + 0.10) / 1.10
    boundary = 0.10 * 0.5 + 0.20 * 0.6 + 0.18 * 0.9 + 0.12 * 0.7 + 0.15 * 0.6 + 0.12 * 0.8 + 0.05 * 0.5 + 0.08 * 0.9
    assert r["hub_score"] == pytest.approx(hub, abs=1e-6) and r["boundary_score"] == pytest.approx(boundary, abs=1e-6)
    assert r["hub_contradictions"] == 0 and r["outlier_contradictions"] == 2 and r["primary_role"] == "boundary" if boundary > hub else "hub"


def test_plausibility(spark):
    rows = [(0.0, 0.01, None), (0.5, 0.01, None), (-1.0, 0.3, "icsd-7"), (-1.0, None, "yes"), (None, None, "unknown"), (-1.0, 0.15, "no")]
    df = spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(rows)], "jid string, formation_energy double, energy_above_hull double, known_synthesized string")
    got = {r["jid"]: (r["physical_label"], r["physical_score"]) for r in P.annotate_records(df).collect()}
    assert got == {"r0": ("stable_or_known", 0.95), "r1": ("metastable_or_uncertain", 0.6), "r2": ("high_metastability_warning", 0.5), "r3": ("stable_or_known", 1.0), "r4": ("insufficient_data", 0.35), "r5": ("high_metastability_warning", 0.55)}
    pairs = spark.createDataFrame([("r0", "r0"), ("r0", "r1"), ("r0", "r5"), ("r0", "nowhere")], "a string, b string")
    out = P.annotate_pairs(pairs, P.annotate_records(df), a="a", b="b")
    assert {(r["a"], r["b"]): r["pair_label"] for r in out.collect()} == {("r0", "r0"): "plausible_pair", ("r0", "r1"): "plausible_but_uncertain", ("r0", "r5"): "topology_only_warning", ("r0", "nowhere"): "insufficient_data"}
    assert P.soft_filter(out).count() == 3


def test_store_operations(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 3.0)], "jid string, v double")
    b = spark.createDataFrame([("y", 9.0), ("z", 4.0)], "jid string, v double")
    assert {(r["jid"], r["v"]) for r in U.union_universe([a, b]).collect()} == {("x", 1.0), ("y", 2.0), ("z", 4.0)}
    one = U.union_universe([a])
    assert {(r["jid"], r["v"]) for r in U.upsert(one, b).collect()} == {("x", 1.0), ("y", 9.0), ("z", 4.0)}
    assert {(r["jid"], r["v"]) for r in U.upsert(one, b, overwrite=False).collect()} == {("x", 1.0), ("y", 2.0), ("z", 4.0)}
    assert U.remove(one, b).count() == 1
    stats = {r["feature"]: r for r in U.feature_stats(a, ["v"]).collect()}
    assert stats["v"]["std"] == pytest.approx(np.std([1, 2, 3]))
    matrix = [r["v"] for r in U.feature_matrix(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", float("inf"))], "jid string, v double"), ["v"]).orderBy("jid").collect()]
    assert matrix == pytest.approx([-math.sqrt(2), 0, math.sqrt(2), 0])
    drawn = U.sample_strata(a.withColumn("jid", F.concat("jid", F.col("v").cast("string"))), [("all", F.lit(True), 2), ("low", F.col("v") < 3, 1)], seed=3)
    assert 2 <= drawn.count() <= 3


def test_cohort(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.03, (5, 2)), rng.normal(0.6, 0.03, (4, 2))])
    distance = np.clip(np.linalg.norm(xy[:, None] - xy[None], axis=2), 0, 1)
    labels, tried = K.choose_clusters(distance)
    assert labels.tolist() == [1] * 5 + [2] * 4 and tried[0][0] == 2
    assert np.allclose(np.linalg.norm(K.classical_scaling(distance)[:, None] - K.classical_scaling(distance)[None], axis=2), distance, atol=1e-6)
    ids = [f"e{i}" for i in range(9)]
    pairs = spark.createDataFrame([(ids[i], ids[j], float(1 - distance[i, j])) for i in range(9) for j in range(i + 1, 9)], "a string, b string, s double")
    long = H.filled(H.both_ways(pairs, "s"))
    near = H.nearest(long, 3).collect()
    assert len(near) == 27
    for i, e in enumerate(ids):
        want = [ids[j] for j in np.argsort(distance[i]) if j != i][:3]
        assert [r["other"] for r in sorted((r for r in near if r["id"] == e), key=lambda r: r["neighbour_rank"])] == want
    clustered = K.cluster_cohort(long)
    assert {r["id"]: r["cluster_id"] for r in clustered.collect()} == dict(zip(ids, labels.tolist()))
    border = H.between_clusters(long, clustered).collect()
    assert all(r["own_similarity"] > r["other_similarity"] for r in border)
    summary = {r["cluster_id"]: r for r in H.cluster_summary(long, clustered, clustered.select("id", F.lit(1.0).alias("reliability"))).collect()}
    assert summary[1]["cluster_size"] == 5 and summary[1]["representative"] == ids[int(distance[:5, :5].mean(1).argmin())]
    assert H.effective_clusters(clustered).first()[0] == pytest.approx(math.exp(-sum(p * math.log(p) for p in (5 / 9, 4 / 9))))
    ranks = {r["id"]: r["percentile_rank"] for r in H.distinctiveness(long, 3).collect()}
    assert min(ranks.values()) > 0 and max(ranks.values()) == 1.0


def test_spearman_with_ties(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (2.0, 5.0), (4.0, 4.0), (None, 1.0)]
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    xs, ys = zip(*rows[:4])
    r = H.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert r["n"] == 4 and r["rho"] == pytest.approx(np.corrcoef(rank(xs), rank(ys))[0, 1])
    assert H.spearman(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y").first()["rho"] is None


def test_components(spark):
    rng = random.Random(7)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("hub", f"h{i}") for i in range(300)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)] + [("self", "self"), (None, "x")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), left="a", right="b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and a != b:
            parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), []).append(x)
    assert got == {x: min(g) for g in groups.values() for x in g}


POSCAR = """rocksalt
1.0
4.0 0.0 0.0
0.0 4.0 0.0
0.0 0.0 4.0
Na Cl
4 4
Direct
0 0 0
0 0.5 0.5
0.5 0 0.5
0.5 0.5 0
0.5 0.5 0.5
0.5 0 0
0 0.5 0
0 0 0.5
"""


def test_structures_and_results(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "POSCAR_a").write_text(POSCAR)
    (tmp_path / "s" / "broken.vasp").write_text("no structure")
    (tmp_path / "s" / "other.txt").write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in E.validate(E.read_structures(spark, str(tmp_path / "s"))).collect()}
    good = rows["POSCAR_a"]
    assert good["formula"] == "Cl4Na4" and good["volume"] == pytest.approx(64) and good["coord_mean"] == 18 and good["validation_status"] == "accepted"
    assert rows["broken.vasp"]["validation_status"] == rows["other.txt"]["validation_status"] == "rejected_parse_failure"
    for folder, text in {"a": {"schema_version": "v", "query": {"jid": "J1"}}, "b": {"schema_version": "v", "query": {"jid": "J1"}}, "c": {"schema_version": "w"}, "d": None}.items():
        (tmp_path / "r" / folder).mkdir(parents=True)
        (tmp_path / "r" / folder / "f.json").write_text(json.dumps(text) if text else "{broken")
    got = {r["path"].rsplit("/", 2)[1]: (r["id"], r["status"]) for r in E.discover_results(spark, str(tmp_path / "r"), "f.json", "v").collect()}
    assert got == {"a": ("J1", "compatible"), "b": ("J1", "duplicate"), "c": ("c", "incompatible_schema"), "d": ("d", "unreadable")}
    (tmp_path / "jobs.csv").write_text("jid\n# note\njvasp-12,x\nJVASP-3\nJVASP-12\n\n")
    assert [r["jid"] for r in E.read_jobs(spark, str(tmp_path / "jobs.csv")).collect()] == ["JVASP-12", "JVASP-3"]


def test_stream_of_queries(spark, tmp_path):
    base = cut_lineage(small_universe(spark, 30))
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text(json.dumps({"jid": f"q{i}", "formula": "LiMn2O4", "elements": ["Li", "Mn", "O"], "spacegroup_number": 227, "arrived_at": "2025-01-01T00:00:00"}))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    config = R.PoolConfig().with_sizes(same_family=3, adjacent_family=3, boundary_contrast=3, wildcard=2, negative_control=2)
    T.retrieve_stream(T.query_stream(spark, str(source)), base, out, check, config).awaitTermination()
    (source / "2.json").write_text((source / "0.json").read_text().replace("q0", "q2"))
    T.retrieve_stream(T.query_stream(spark, str(source)), base, out, check, config).awaitTermination()
    ids = spark.read.parquet(out).select("query_id", "batch_id").distinct().collect()
    assert sorted(r["query_id"] for r in ids) == ["q0", "q1", "q2"]
    events = spark.createDataFrame([("2025-01-01 00:10:00", "a", 1.0), ("2025-01-01 00:50:00", "a", 2.0), ("2025-01-01 01:10:00", "b", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["kind"], r["n"], r["total"]) for r in T.event_rates(events).collect()) == [("a", 2, 3.0), ("b", 1, 5.0)]


def test_pairs_of_control_materials_are_kept(spark, tmp_path):
    from vicinage.plans import cohort_queries, retrieval_queries

    tables = {
        "material_record": ([("m1", "Fe2O3", ["Fe", "O"], -1.0, None), ("m2", "NaCl", ["Na", "Cl"], -2.0, None)], "jid string, formula string, elements array<string>, formation_energy_peratom double, loaded_at timestamp"),
        "candidate_pool": ([("m1", "true", None)], "candidate_jid string, known_synthesized string, loaded_at timestamp"),
        "control_materials": ([("c1", "FeS2"), ("m2", "KBr3")], "jid string, formula string"),
        "nearest_contextual_neighbours_1c2": ([("c1", "m1"), ("c1", "m1"), ("m1", "m2"), ("gone", "m1"), ("m2", "gone")], "candidate_id string, neighbour_id string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["candidate_id"], r["neighbour_id"]): r["jaccard"] for r in cohort_queries.q_element_jaccard(spark, str(tmp_path)).collect()}
    assert got == {("c1", "m1"): round(1 / 3, 6), ("m1", "m2"): 0.0, ("gone", "m1"): None, ("m2", "gone"): None}
    deltas = {(r["jid_a"], r["jid_b"], r["feature"]) for r in retrieval_queries.q_pair_deltas(spark, str(tmp_path)).collect()}
    counts = {"n_elements", "metal_count", "nonmetal_count"}
    assert deltas == {("c1", "m1", f) for f in counts} | {("m1", "m2", f) for f in counts | {"formation_energy"}}
    assert {(r["jid_a"], r["jid_b"]) for r in retrieval_queries.q_pair_screen(spark, str(tmp_path)).collect()} == {("c1", "m1"), ("m1", "m2")}


def test_pools_of_materials_as_queries(spark, tmp_path):
    from vicinage.plans import retrieval_queries

    ids = [f"JVASP-{n}" for n in range(1, 61)] + ["EXT-20250918-0020"]
    spark.createDataFrame([(j, "Fe2O3" if i % 2 else "NaCl", None) for i, j in enumerate(ids)], "jid string, formula string, loaded_at timestamp").write.parquet(f"{tmp_path}/material_record.parquet")
    spark.createDataFrame([], "candidate_jid string, known_synthesized string, loaded_at timestamp").write.parquet(f"{tmp_path}/candidate_pool.parquet")
    rows = retrieval_queries.queries()["material_pools"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in rows} == {"JVASP-20", "JVASP-40", "JVASP-60"}
    assert all(r["query_id"] != r["candidate_id"] for r in rows)
