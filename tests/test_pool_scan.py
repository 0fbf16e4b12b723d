import pytest
from pyspark.sql import functions as F
from tests.test_reference_operators import small_universe

from vicinage.operators import pool_scan as PS
from vicinage.operators import retrieval as R
from vicinage.session import cut_lineage

COLUMNS = [c.split()[0] for c in PS.REPORTED.split(", ")]


@pytest.fixture(scope="module")
def base(spark):
    """Records of few systems, some without symmetry, some of a structure family, one query without elements."""
    rows = small_universe(spark, 150, seed=7)
    number = F.substring("jid", 2, 3).cast("int")
    bare = number % 9 == 0
    rows = rows.withColumn("spacegroup_number", F.when(~bare, F.col("spacegroup_number"))).withColumn("crystal_system_code", F.when(~bare | (number % 2 == 0), F.col("crystal_system_code")))
    rows = rows.withColumn("prototype_family", F.when(number % 5 == 0, "spinel_like").otherwise(F.col("prototype_family"))).withColumn("structure_variant", F.when(number % 10 == 0, "normal").otherwise(F.col("structure_variant")))
    return cut_lineage(rows.withColumn("elements", F.when(number == 8, F.array().cast("array<string>")).otherwise(F.col("elements"))))


CONFIGS = {
    "quotas": R.PoolConfig(quotas=dict.fromkeys(R.POOLS, 2)).with_sizes(same_family=9, adjacent_family=9, boundary_contrast=9, wildcard=6, negative_control=4),
    "without quotas": R.PoolConfig(quotas=dict.fromkeys(R.POOLS, 0)).with_sizes(same_family=12, adjacent_family=5, boundary_contrast=7, wildcard=30, negative_control=3),
    "everything": R.PoolConfig(),
    "none": R.PoolConfig(control_most_overlap=1).with_sizes(same_family=0, adjacent_family=3, boundary_contrast=2, wildcard=0, negative_control=5),
}


@pytest.mark.parametrize("config", CONFIGS.values(), ids=CONFIGS.keys())
def test_same_rows_as_retrieval(base, config):
    queries = cut_lineage(R.query_rows(base.filter("jid < 'm012' or jid = 'm120'")))
    expected = sorted(map(str, R.all_pools(base, queries, config).select(COLUMNS).collect()))
    assert expected
    # one piece; pieces that stay in memory; more pieces than stay
    for rows in (1000, 60, 20):
        got = sorted(map(str, PS.chosen(base, queries, config, rows_per_piece=rows).select(COLUMNS).collect()))
        assert got == expected, rows


def test_only_queries_are_exchanged(spark, tmp_path):
    from vicinage.plans import retrieval_queries

    spark.createDataFrame([(f"JVASP-{n}", "Fe2O3", None) for n in range(1, 61)], "jid string, formula string, loaded_at timestamp").write.parquet(f"{tmp_path}/material_record.parquet")
    spark.createDataFrame([], "candidate_jid string, known_synthesized string, loaded_at timestamp").write.parquet(f"{tmp_path}/candidate_pool.parquet")
    df = retrieval_queries.queries()["material_pools"](spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == sum(len({r["candidate_id"] for r in rows if (r["query_id"], r["pool_name"]) == k}) for k in {(r["query_id"], r["pool_name"]) for r in rows})
    plan = df._jdf.queryExecution().executedPlan().toString()
    # entries that are joined or ranked are exchanged; what spreads the queries is a round robin
    assert not any(x in plan for x in ("Join", "Window", "Sort", "hashpartitioning"))
