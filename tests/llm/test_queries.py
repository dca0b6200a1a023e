import duckdb
import pytest

import __spark_entry__ as entry
from foliant.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("edits", "documents"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_sql_gives_the_same_rows(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    rel = con.sql(llm.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_pieces_cover_every_source(spark, con):
    """Over all rows: pieces within the limit, each after the first beginning with the last 100 characters before it, up to the end."""
    pieces = {}
    for r in entry.queries()["p1_pieces"](spark, DATA).collect():
        pieces.setdefault(r.seq, []).append(r)
    texts = dict(con.sql("select distinct seq, source from edits where length(source) > 0").fetchall())
    assert set(pieces) == set(texts)
    for seq, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start_char == 0 and own[-1].end_char == len(texts[seq])
        assert all(r.end_char - r.start_char <= 1200 for r in own) and all(b.start_char == a.end_char - 100 for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - {"p1_pieces", "p1_found", "p4_found"}))
def test_other_queries_give_each_row_once(spark, name):
    rows = [tuple(map(str, r)) for r in entry.queries()[name](spark, DATA).collect()]
    assert rows and len(rows) == len(set(rows))
