"""Every query against its SQL twin on a small part of the given tables."""

import os

import duckdb
import pytest

from cuelane.plans import catalog

SOURCE = os.environ.get("CUELANE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    con = duckdb.connect()
    keep = {"documents": "WHERE doc_id < 40 AND n_chars < 4000", "embeddings": "WHERE vec_id < 60", "lineitem": "WHERE l_orderkey < 300", "pages": "LIMIT 20", "events": "WHERE user_id % 4 = 0"}
    for t in TABLES:
        con.execute(f"COPY (SELECT * FROM '{SOURCE}/{t}.parquet' {keep.get(t, '')}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(float(v))
    return None if v is None else str(v)


QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    d, con = small
    df = QUERIES[name](spark, d)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in SQL:
        got = con.execute(SQL[name])
        cols = [c[0] for c in got.description]
        assert set(cols) == set(df.columns)
        at = [df.columns.index(c) for c in cols]
        assert sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr) == sorted((tuple(map(norm, r)) for r in got.fetchall()), key=repr)
