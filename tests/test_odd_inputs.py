"""Queries against their SQL on tables with odd rows that the given ones do not hold."""

import duckdb

from quirelake.plans import queries

# lines that begin or end as numbers, labels and names do, and blank ones
LINES = [
    "81.139.43.1 Eine", "12.5 x", "12.5", "12. x", "12.  x", "12.", "12.\tx", "3 x", "3) x", ".5 x", "12.5.6 x", "1234. x", "12.5\u0085", "Unit 3 x", "References", "Table of contents", "Resources for further reference:",
    "see image 5", "image 5", " ", "\t", "\u00a0", "\u200b", "", "\ufeff2. x", "x", "2 – x", "– 2", "“4.1 x”", "1 . 2 x", "99999999999 x",
]


def documents(spark, folder):
    """Each of the lines at many places of many documents."""
    rows = [(i, "\n".join(LINES[(i * 7 + j * (1 + i % 5)) % len(LINES)] for j in range(40))) for i in range(200)]
    spark.createDataFrame([*rows, (900, "x\n" * 1100), (901, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def check(spark, folder, name, *tables):
    df = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    columns = sorted(df.columns)
    want = con.sql(queries.SQL[name]).select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert want and sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_styles_of_lines_with_numbers_of_their_own(spark, tmp_path):
    documents(spark, tmp_path)
    check(spark, tmp_path, "fn_03_promote_heading", "documents")


def test_levels_of_lines_with_numbers_of_their_own(spark, tmp_path):
    documents(spark, tmp_path)
    check(spark, tmp_path, "fn_02_heading_by_number", "documents")
