"""Small document tables for the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or full tuples."""
    full = [(r[0], r[1], "en", "s", None if r[1] is None else len(r[1])) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, schema)


def given(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


ODD = [
    (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a"), (4, "é ß   x"), (5, "one two three four five six"),
    (6, "one two three four five six"), (6, "one two three four five six"), (7, "w" * 5000), (8, "long text " * 3000),
    (None, "no id here"), (None, None), (9, "\U0001f600 emoji <|endoftext|> and  double  blanks \n new"),
]
