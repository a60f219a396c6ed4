import re

import corpus_pipeline as cp
from helpers import ODD, SCHEMA, given, table
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_packing import check

from quirelake.llm import secret_scan


def expected(rows):
    """(doc_id, text) that the stages before packing leave, by plain Python."""
    rows = [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = max(best.get(key, (-1, 0, "")), (len(t), -i, t))
    rows = [(-i, t) for _, i, t in best.values()]
    stay = {i for i, _, c in brute(rows, 5, 80) if i == c}
    out = []
    for i, t in rows:
        if i in stay:
            at, parts = 0, []
            for a, b, _, _ in secret_scan.base_spans(t):
                if b > at:
                    parts += [t[at : max(a, at)], "[REDACTED]" if a >= at else ""]
                    at = b
            out.append((i, "".join([*parts, t[at:]])))
    return sorted(out)


def test_stages_against_plain_python(spark, tmp_path):
    docs = given(spark)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    step = docs
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, step, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        step = spark.read.parquet(str(tmp_path / str(k)))
        assert step.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in step.collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [t for _, t in got] == [t for _, t in want]
    assert all(r.n_chars == len(r.text) for r in step.collect())
    check(step, cp.run(spark, "/root/testdata/sf0.001"))


def test_stages_on_odd_rows_and_extra_columns(spark):
    docs = table(spark, ODD).selectExpr("*", "1 AS score", "'x' AS lang_pred", "array(1) AS secrets", "0 AS keep_id")
    left = docs
    for _, stage in cp.STAGES[:-1]:
        left = stage(spark, left, "")
        assert left.columns == docs.columns
    got = sorted(str(r.doc_id) for r in left.collect())
    assert got == sorted(["3", "4", "5", "7", "8", "None", "9"])
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_the_language_model_fills_what_is_missing(spark):
    """The stage's answer depends on its model: languages that are not given are predicted, given ones stay."""
    docs = given(spark, "sf0.01")
    known = {r.doc_id: r.lang for r in docs.collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang")))
    left = cp.identify_language(spark, hidden, "").collect()
    assert all(r.lang is not None for r in left)
    assert all(r.lang == known[r.doc_id] for r in left if r.doc_id % 3 and known[r.doc_id] is not None)
    told = [(r.lang, known[r.doc_id]) for r in left if r.doc_id % 3 == 0 and known[r.doc_id] is not None and len(r.text) > 40]
    assert len({t for t, _ in told}) > 2 and sum(a == b for a, b in told) >= 0.9 * len(told)
    # labels turned round turn the answers round
    other = {"en": "es", "es": "en"}
    swapped = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("lang") == "en", "es").when(F.col("lang") == "es", "en").otherwise(F.col("lang")))
    again = {r.doc_id: r.lang for r in cp.identify_language(spark, swapped, "").collect()}
    told = [(again[r.doc_id], other[r.lang]) for r in left if r.doc_id % 3 == 0 and r.lang in other and len(r.text) > 40]
    assert told and sum(a == b for a, b in told) >= 0.9 * len(told)


def test_the_language_of_a_text_is_told_once(spark):
    """One call of the model a row: the plan that drops and fills holds it once."""
    import contextlib
    import io

    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        cp.identify_language(spark, given(spark), "").explain()
    assert plan.getvalue().count("ArrowEvalPython") == 1
