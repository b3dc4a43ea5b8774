"""Every registered query runs, and equals its DuckDB twin, on the smallest tables (where those are present)."""

import os

import pytest

import oracle_check
from ranksmith.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    out = duckdb.connect()
    for t in oracle_check.TABLES:
        out.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle_check.rows(got) == oracle_check.rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(ORACLE_SQL) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["semantic_ingest", "semantic_dense_max"])
def test_documents_without_chunks(spark, tmp_path, name):
    """Null, empty and blank texts have no chunks, and so no rows."""
    import duckdb

    rows = [(1, "eel\nsee me\n"), (2, ""), (3, "   "), (4, None), (5, "\n"), (6, " \nend")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert oracle_check.rows(got) == oracle_check.rows(want)
    assert set(got["doc_id"]) == {1, 5, 6}
