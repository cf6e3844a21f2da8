import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source); columns that clash come along."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 7) for r in rows]
        columns = "doc_id long, text string, lang string, source string, n_chars long, id string, kept int"
        return spark.createDataFrame(full, columns)

    return make


@pytest.fixture(scope="session")
def agrees(tables):
    """Compares a query with its SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from tablewright.llm import queries
    from tools.check_oracles import compare, type_gaps

    db = duckdb.connect()
    for file in os.listdir(tables):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{file}'")

    def check(spark, name):
        df = queries.QUERIES[name](spark, tables)
        relation = db.sql(queries.ORACLES[name])
        assert compare([tuple(r) for r in df.collect()], df.columns, relation.fetchall(), relation.columns) is None
        assert type_gaps(df, relation) == {}

    return check
