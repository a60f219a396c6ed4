import hashlib
import re

import pytest
from helpers import ODD, given, table
from pyspark.sql import functions as F

from quirelake.llm import common
from quirelake.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    out = []
    for key, members in groups.items():
        best = min(m[:3] for m in members)
        keep = min(members, key=lambda m: m[:3])[3]
        for m in members:
            out.append((m[3], keep, len(members), m[:3] == best, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [common.MOST_BITS, 3])
def test_against_plain_python(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MOST_BITS", bits)  # without a filter there is only more work
    hot = [(100 + i, "same text" + " " * (i % 3)) for i in range(60)]
    for docs in (given(spark), table(spark, ODD), table(spark, hot + ODD), table(spark, [])):
        assert got(ed.exact_dedup(docs, digest_all=True)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_digest_only_where_a_copy_is_possible(spark):
    rows = {r.doc_id: r for r in ed.exact_dedup(table(spark, [(1, "a b"), (2, "ab"), (3, "other")])).collect()}
    assert rows[1].text_sha256 == rows[2].text_sha256 is not None and rows[2].keep_id == 1
    assert rows[3].kept and rows[3].group_size == 1


def test_each_level_reads_what_the_one_before_left(spark):
    head = "h" * 2 * ed.PREFIX
    docs = table(spark, [(1, "one length"), (2, "two\tlengths here"), (3, head + "aa"), (4, head + " ab"), (5, head + "aa "), (6, "x" + head + "a")])
    lengths = ed.repeated_lengths(docs)
    assert ed.prefixes(docs, lengths).count() == 4  # 1 and 2 share their length with none
    told = {r.doc_id: r.text_sha256 for r in ed.digests(docs).collect()}
    assert [i for i, sha in sorted(told.items()) if sha] == [3, 4, 5]  # 6 shares its length alone
    assert told[3] == told[5] != told[4]


def test_one_of_a_group_stays(spark):
    left = ed.drop_copies(table(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, None), (None, "")]))
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("1", "a b"), ("3", "c"), ("None", "")]


def test_rows_go_one_by_one_not_by_their_id(spark):
    rows = [(1, "known text"), (None, "known text"), (None, "only here"), (None, "nor this"), (7, "a b"), (7, "ab"), (7, "other"), (8, "ab"), (7, "other")]
    docs = table(spark, rows).selectExpr("*", "'w' AS word", "1 AS mask", "2 AS survivor", "3 AS _row")
    left = ed.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", "known text"), ("None", "only here"), ("None", "nor this"), ("7", "a b"), ("7", "other")])
    left = ed.drop_copies(docs.where("text <> 'other'"))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", "known text"), ("None", "only here"), ("None", "nor this"), ("7", "a b")])


def test_no_python_on_the_main_path(spark):
    plan = ed.exact_dedup(given(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_column_names_with_dots(spark):
    docs = table(spark, [(1, "a"), (2, "a "), (3, "b")]).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    out = ed.drop_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
