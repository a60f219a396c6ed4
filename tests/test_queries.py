"""Every registered query of the library against its SQL, or for its shape where there is none."""

import duckdb
import pytest

from quirelake.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    if name not in queries.SQL:
        assert rows
        return
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    picked = want.select(", ".join(f'"{c}"' for c in columns))
    assert rows == sorted((tuple(plain(v) for v in r) for r in picked.fetchall()), key=str)
