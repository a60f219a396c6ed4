"""Literal rows that pin the rules, and the sequential operators against plain restatements."""

import datetime as dt
import random
import threading

from pyspark.sql import functions as F

from quirelake.functions import rules, urls
from quirelake.functions import text as tx
from quirelake.operators import filters, layout, matching, sampling
from quirelake.sources import sinks


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1).select(expr).collect()]


def test_heading_level_by_number(spark):
    rows = {
        "12.1 Title": 1, "12.1.3 Title": 2, "12.1.3.2 Title": 3, "2 Introduction": 1, "Unit 12 – Title": 1, "2026 Report": None, "References": None,
        "Unit 12 Chapter 1 Image 3": None, "​12 . 1 Title": 1, "": None, "7": None, "Resources for further reference:": 1, "4)": None, "4) x": 1,
    }
    assert values(spark, list(rows), tx.heading_level_by_number(F.col("x"))) == list(rows.values())


def test_compatibility_form(spark):
    assert values(spark, ["ﬁ  Ａ\x07", None], tx.heading_text(F.col("x"), compatible=True)) == ["fi A", None]


def test_numbers_in_labels_and_names(spark):
    rows = {"Image 2": 2, "Unit 12 Chapter 1 Image 25": 25, "This paragraph refers to Image 2.": None, "IMAGE​ 05": 5, "x" * 241: None}
    assert values(spark, list(rows), tx.placeholder_number(F.col("x"))) == list(rows.values())
    names = {"1.jpg": 1, "Image 12.png": 12, "Image_003.webp": 3, "course-image.jpg": None, "a/b/007": 7}
    assert values(spark, list(names), tx.file_number(F.col("x"))) == list(names.values())


def test_paths_and_names(spark):
    paths = {"folder/unit.docx": True, "../unit.docx": False, "/absolute/unit.docx": False, "C:/temp/unit.docx": False, "__MACOSX/._unit.docx": False, "": False, None: False}
    assert values(spark, list(paths), filters.safe_path(F.col("x"))) == list(paths.values())
    assert values(spark, ["Unit_01_Written_Assignment_Template.docx", "Unit 01 - Learning Content.docx"], tx.is_skipped_document(F.col("x"))) == [True, False]
    assert values(spark, ["=1+1", "  -x", "ok", "@a"], tx.csv_safe(F.col("x"))) == ["'=1+1", "'  -x", "ok", "'@a"]


def test_subject_rules(spark):
    titles = {"Award in Managing a Care Team Skills for New Managers": "adult_safeguarding", "Safe Administration of Medication": "healthcare", "Award in Early Years Safeguarding": "child_safeguarding"}
    assert values(spark, list(titles), rules.domain_of(F.col("x"), F.lit(""), F.lit(""), F.lit(""))) == list(titles.values())
    content = rules.domain_of(F.col("x"), F.lit("Hand hygiene"), F.lit("on the hospital ward"), F.lit(""))
    assert values(spark, ["Unit 2", "Leadership and Management", "Something else"], content) == ["healthcare"] * 3
    assert values(spark, ["business team office meeting"], rules.locked_query(F.col("x"), F.lit("adult_safeguarding"))) == ["care worker business team office meeting"]
    assert values(spark, ["business negotiation"], rules.wider_query(F.col("x"))) == ["business meeting"]


def test_metadata_gate(spark):
    gate = rules.metadata_decision(F.col("x"), F.lit("adult_safeguarding"), F.lit("Managing a care team"), F.lit("care team meeting"), F.lit(True))
    got = values(spark, ["Corporate executive meeting in a boardroom", "Care workers and nursing staff in a care home team meeting", "Office group meeting", ""], gate)
    assert [g.eligible for g in got] == [False, True, False, False] and got[1].score >= 80
    assert got[0].reason.startswith("Corporate") and got[3].reason.startswith("Missing")


def test_concept_rank(spark):
    c = rules.concepts
    pairs = [("business negotiation discussion", "business, office, meeting"), ("manager leading office meeting", "sunset, mountains, lake, office")]
    got = values(spark, pairs, rules.concept_rank(c(F.col("q")), c(F.lit("")), c(F.col("t"))), "q string, t string")
    assert got[0] > 0 == got[1]


def test_urls(spark):
    rows = ["https://a.com/x.PNG?y", "http://10.1.2.3/", "https://user@a.com/", "https://www.freepik.com/free-photo/blue-sky_123.htm", "ftp://a.com/photo", "https://a.com/p?fm=jpg", "https://a.com/page"]
    assert values(spark, rows, urls.looks_like_image(F.col("x"), F.lit("link"))) == [True, False, False, True, False, True, False]
    assert values(spark, rows, urls.is_public(F.col("x"))) == [True, False, False, True, False, True, True]
    assert values(spark, rows[3:4], urls.resource_slug(F.col("x"))) == ["blue-sky"] and values(spark, rows[3:4], urls.resource_id(F.col("x"))) == [123]


def test_missing_and_unused(spark):
    wanted = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 7), (2, 1, 7)], "doc_id long, pos int, number int")
    files = spark.createDataFrame([(1, 1, "1.jpg", 1), (1, 3, "3.jpg", 2), (2, 7, "Image 7.png", 3), (2, 7, "7.png", 4)], "batch_id long, number int, filename string, file_id int")
    chosen = matching.pick_per_number(files)
    assert sorted(map(tuple, matching.missing_and_unused(wanted, chosen).collect())) == [(1, 2, "missing"), (1, 3, "unused")]
    assert sorted((r.doc_id, r.number, r.filename) for r in matching.placements(wanted, chosen).collect()) == [(1, 1, "1.jpg"), (1, 2, None), (2, 7, "7.png"), (2, 7, "7.png")]


def test_batches_of_a_queue(spark):
    queue = spark.createDataFrame([("r", i, True) for i in range(20)], "review string, place int, found boolean")
    first = sampling.batch_budget(queue, "review", "place")
    second = sampling.batch_budget(queue, "review", "place", cursor=16, found_before=16)
    assert (first.count(), second.count()) == (16, 4)
    assert sampling.batch_budget(queue.withColumn("found", F.lit(False)), "review", "place", lookups=7).count() == 7


def test_unique_names(spark):
    names = ["a.jpg", "A.jpg", "a_2.jpg", "a.jpg", "b", "b", ".x", ".x"]
    files = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "batch_id int, file_id int, filename string")
    got = [r.unique_name for r in sampling.unique_names(files, "batch_id", "file_id").orderBy("file_id").collect()]
    assert got == ["a.jpg", "A_2.jpg", "a_2_2.jpg", "a_3.jpg", "b", "b_2", ".x", ".x_2"]


def test_requests_served_from_store(spark):
    hours = [0, 5, 24, 25, 40, 49.5, 50]
    rows = [("k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int")
    got = [(r.saved_at - rows[0][1]).total_seconds() / 3600 for r in matching.served_from_store(df).orderBy("id").collect()]
    assert got == [0, 0, 0, 25, 25, 49.5, 49.5]


def test_greedy_choice_and_half_coverage(spark):
    plans = spark.createDataFrame([(1, i, i) for i in range(3)], "review int, plan int, turn int")
    ranked = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "a", 1), (1, 1, "c", 2), (1, 2, "a", 1)], "review int, plan int, identifier string, rank int")
    got = sorted((r.plan, r.identifier) for r in sampling.greedy_unique(plans, ranked, "review", "plan", "turn").collect())
    assert got == [(0, "a"), (1, "c")]
    half = spark.createDataFrame([(1, i, "q" if i != 1 else "z") for i in range(4)], "chapter int, para_index int, query string")
    assert sorted(r.para_index for r in sampling.half_coverage(half).collect()) == [1, 3]


def test_fuzzy_replacement(spark):
    retired = spark.createDataFrame([(1, "blue-sky-photo"), (2, "zzz")], "id int, slug string")
    catalogue = spark.createDataFrame([(1, "blue-sky-photo"), (7, "blue-sky-photos"), (8, "blue-sky-photo"), (9, "red")], "other_id int, other_slug string")
    got = matching.replacements(retired, catalogue).collect()
    assert [(r.id, r.other_id, r.score) for r in got] == [(1, 8, 1.0)]


def test_lineage_stops_at_cycles_and_failures(spark):
    jobs = spark.createDataFrame([(1, None, "format", "completed"), (2, 1, "edit", "completed"), (3, 2, "edit", "failed"), (4, 3, "edit", "completed"), (5, 6, "edit", "completed"), (6, 5, "edit", "completed")], "job_id int, parent_id int, job_type string, status string")
    got = sorted((r.start, r.depth, r.job_id, r.label) for r in matching.lineage(jobs, F.when(F.col("job_type") == "format", "First").otherwise(F.col("job_type"))).collect())
    assert got == [(1, 0, 1, "First"), (2, 0, 2, "edit"), (2, 1, 1, "First"), (4, 0, 4, "edit"), (5, 0, 5, "edit"), (5, 1, 6, "edit"), (6, 0, 6, "edit"), (6, 1, 5, "edit")]


def test_lineage_of_long_chains_and_rings(spark):
    chain = [(i, i - 1 if i else None, "t", "completed") for i in range(120)]
    ring = [(1000 + i, 1000 + (i + 1) % 7, "t", "completed") for i in range(7)] + [(2000, 1000, "t", "completed"), (3000, 3000, "t", "completed")]
    jobs = spark.createDataFrame(chain + ring, "job_id int, parent_id int, job_type string, status string")
    got = matching.lineage(jobs).collect()
    assert sorted((r.depth, r.job_id) for r in got if r.start == 119) == [(k, 119 - k) for k in range(120)]
    assert sorted((r.depth, r.job_id) for r in got if r.start == 2000) == [(0, 2000), *[(k + 1, 1000 + k) for k in range(7)]]
    assert [(r.depth, r.job_id) for r in got if r.start == 3000] == [(0, 3000)]
    assert len(got) == 120 * 121 // 2 + 7 * 7 + 8 + 1


def test_equal_requests_stay_apart(spark):
    at = dt.datetime(2024, 1, 2)
    left = spark.createDataFrame([("k", at), ("k", at), ("z", at)], "key string, ts timestamp")
    right = spark.createDataFrame([("k", at - dt.timedelta(hours=3))] * 2, "key string, ts timestamp")
    assert sorted((r.key, r.found) for r in matching.latest_within(left, right, "key", 24).where("found IS NOT NULL").collect()) == [("k", at - dt.timedelta(hours=3))] * 2
    assert matching.latest_within(left, right, "key", 24).count() == 3


def test_latest_within_against_a_loop(spark):
    rng = random.Random(5)
    at = dt.datetime(2024, 1, 2)
    moment = lambda: rng.choice([None, *[at + dt.timedelta(minutes=20 * rng.randint(0, 400))] * 9])
    left = [(rng.choice(["a", "b", "c", None]), moment(), i) for i in range(400)]
    right = [(rng.choice(["a", "b", None]), moment()) for _ in range(40)]
    want = {i: max((r for j, r in right if j == k and None not in (k, r, t) and t - dt.timedelta(hours=24) <= r <= t), default=None) for k, t, i in left}
    for kind in ("timestamp", "timestamp_ntz"):
        got = matching.latest_within(spark.createDataFrame(left, f"key string, ts {kind}, id int"), spark.createDataFrame(right, f"key string, ts {kind}"), "key", 24).collect()
        assert len(got) == 400 and {r.id: r.found for r in got} == want and {(r.key, r.ts, r.id) for r in got} == set(left)
    assert sum(x is None for x in want.values()) > 50 and sum(x is not None for x in want.values()) > 50


def test_a_hundred_thousand_requests_of_one_key_in_an_hour(spark):
    """Each is looked up among all before it, which must not pair them: a minute would not do for ten thousand million pairs."""
    times = spark.range(100_000).selectExpr("'k' as key", "timestamp_millis(1704153600000 + id * 30) as ts", "id")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = matching.latest_within(times, times.selectExpr("key", "ts + interval 7 milliseconds as ts"), "key", 24).selectExpr("count(*)", "count(found)", "count_if(ts - found = interval 23 milliseconds)").first()
    finally:
        timer.cancel()
    assert tuple(got) == (100_000, 99_999, 99_999)


def test_heading_levels(spark):
    styles = spark.createDataFrame([("a", "My Heading 2", None, None), ("b", "Lead", None, "a"), ("c", "TOC 1", None, "a"), ("d", "x", 3, None), ("e", "y", None, "f"), ("f", "z", None, "e")], "style_id string, name string, outline int, base string")
    told = {r.style_id: (r.contents, r.style_level) for r in filters.style_levels(styles, []).collect()}
    assert told == {"a": (False, 2), "b": (False, 2), "c": (True, None), "d": (False, 4), "e": (False, None), "f": (False, None)}
    rows = [("2.3 Safe handling", 1.0, 2), ("2 Intro", 1.0, None), ("2.3.4 More", 0.6, 3), ("Unit 4: Care", 0.9, 1), ("2.3 Support for medicines", 0.5, None), ("2.3 " + "x" * 130, 1.0, None)]
    df = spark.createDataFrame(rows, "t string, b double, want int")
    level = filters.heading_level(F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("t"), F.col("b"))
    assert all(r.level == r.want for r in df.withColumn("level", level).collect())


def test_report_sections_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", "h", None)], "Chapter string, Heading string, `Suggested search words` string")
    notes = spark.createDataFrame([(" -x",)], "`Processing notices` string")
    sinks.write_report({"missing": rows, "notices": notes}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/missing").first().Chapter == "'=1+1"
    assert spark.read.option("header", True).csv(f"{tmp_path}/notices").columns == list(sinks.REPORT["notices"])


def test_stock_items(spark):
    rows = [("7", "photo", "Landscape", ["Free"], []), ("8", "photo", "vertical", ["freemium"], None), ("9", "vector", "landscape", ["free"], []), ("10", "photo", "landscape", ["premium"], []), ("11", "photo", "landscape", ["free"], ["p"]), ("x", "photo", "landscape", ["free"], [])]
    items = spark.createDataFrame(rows, "id string, kind string, orientation string, licences array<string>, products array<string>")
    assert [r.id for r in filters.eligible_stock(items).collect()] == ["7"] and [r.id for r in filters.eligible_stock(items, portrait=True).collect()] == ["8"]


def test_excluded_sections_against_a_loop(spark):
    rng, rows, want = random.Random(5), [], set()
    for doc in range(60):
        limit = None
        for i in range(rng.randrange(25)):
            kind = rng.choice(["body", "head", "skip", "skip_only", "head"])
            level = rng.randrange(1, 4)
            rows.append((doc, i, kind, level, kind != "body", "text"))
            if kind == "skip":
                limit = level
            elif kind == "head":
                if limit is not None and level > limit:
                    continue
                limit = None
                want.add((doc, i))
    par = spark.createDataFrame(rows, "doc_id int, para_index int, kind string, level int, is_heading boolean, text string")
    assert {(r.doc_id, r.para_index) for r in layout.plannable_headings(par).collect()} == want


def test_blank_runs_with_transparent_rows(spark):
    rows = [(1, 0, True, False, False), (1, 1, False, False, True), (1, 2, True, False, False), (1, 3, False, False, False), (1, 4, True, False, False), (1, 5, True, True, False), (1, 6, True, False, False)]
    par = spark.createDataFrame(rows, "doc_id int, para_index int, is_blank boolean, has_break boolean, mark boolean")
    got = sorted(r.para_index for r in layout.collapse_blank_runs(par, transparent=F.col("mark")).collect())
    assert got == [0, 1, 3, 4, 5, 6]


def test_numbered_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    assert sorted((r.x, r.place) for r in sampling.numbered(df, ["x"], "place").collect()) == [(i, i + 1) for i in range(1000)]


def test_package_stands_without_the_optional_part():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quirelake"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
