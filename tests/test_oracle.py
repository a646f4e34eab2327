"""Every query with SQL against DuckDB on the smallest driver tables; the entry point."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are missing")


def _plain(v):
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return round(v, 8) if isinstance(v, float) else v


def _rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(_plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names])), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert _rows(entry.queries()[name](spark, DIR).toArrow()) == _rows(duck.sql(entry.oracle_sql()[name]).to_arrow_table())


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A few documents, some of whose ids are too long for five digits and alike in the first five."""
    import duckdb

    path = str(tmp_path_factory.mktemp("far"))
    d = spark.read.parquet(f"{DIR}/documents.parquet").filter("doc_id < 20").withColumn("doc_id", F.expr("case when doc_id < 8 then doc_id + 10000 else doc_id + 100000 end"))
    d.coalesce(1).write.parquet(f"{path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return path, c


@pytest.mark.parametrize("name", ["extraction_job", "feed_categories", "paper_cells", "paper_dense_cells", "paper_figures", "table_files", "table_groups"])
def test_papers_of_one_shown_id(spark, far, name):
    assert _rows(entry.queries()[name](spark, far[0]).toArrow()) == _rows(far[1].sql(entry.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
