import os

import pytest

import __spark_entry__ as contract
from tools.check_oracles import compare, type_gaps

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["l_returnflag", "revenue"] and found.count() == 3


@needs_tables
@pytest.mark.parametrize("name", ["dedup_first", "join_outer_split", "pivot_gaps", "chi_square_sparse", "recipe_undo", "text_dictionary"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    df = contract.queries()[name](spark, SF_DIR)
    relation = db.sql(contract.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, relation.fetchall(), relation.columns) is None
    assert type_gaps(df, relation) == {}


@needs_tables
def test_no_plan_crosses_tables(spark):
    for name in ("recipe_replay", "outlier_screen", "chi_square", "share_of_total", "chart_histogram", "join_outer_split"):
        plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
