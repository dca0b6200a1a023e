import duckdb
import pytest

import __spark_entry__ as entry
from foliant import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="needs the test tables")


def _same(x):
    return "None" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql_gives_the_same_rows(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    rel = con.sql(core.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(_same, r)) for r in df.select(*cols).collect()) == sorted(tuple(_same(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_all_documents_are_listed(spark):
    """More ranges than one, and no limit."""
    folder = "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = entry.queries()["listed_documents"](spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = {r.doc_id for r in spark.read.parquet(f"{folder}/doc_records.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == ids and len(ids) > 50
    assert sorted(rows, key=lambda r: r.place) == sorted(rows, key=lambda r: (-r.updated_at.timestamp(), r.doc_id)) and sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
