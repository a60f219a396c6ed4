"""Choices in order (names, halves, greedy) against folds in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import sampling


def plain_names(names):
    taken, out = set(), []
    for full in names:
        if full.lower() in taken:
            cut = full.rfind("/") + 1
            dot = full.rfind(".", cut + 1)
            dot = dot if cut < dot < len(full) - 1 else len(full)
            k = 2
            while f"{full[:dot]}_{k}{full[dot:]}".lower() in taken:
                k += 1
            full = f"{full[:dot]}_{k}{full[dot:]}"
        taken.add(full.lower())
        out.append(full)
    return out


def named(spark, rows):
    df = spark.createDataFrame(rows, "batch string, pos long, filename string").withColumn("own", F.struct("pos"))
    got = sampling.unique_names(df, "batch", "pos").collect()
    assert len(got) == len(rows) and all(r.own.pos == r.pos for r in got)
    return {(r.batch, r.pos): r.unique_name for r in got}


def test_unique_names_against_a_fold(spark):
    """Many batches at once: equal names, names with numbers already, suffixes of suffixes, dots and slashes."""
    rng = random.Random(7)
    pool = ["a.jpg", "A.jpg", "a_2.jpg", "a_3.JPG", "a_2_2.jpg", "a_2_3.jpg", "a_4.jpg", "a", "a_2", "a.", "a._2", "a_2.", "a_2._2", "d/a.jpg", "d/a_2.jpg", "d.e/a", "d.e/a_2", ".jpg", ".jpg_2", "_2.jpg", "a_02.jpg", "a_1.jpg", "a_10.jpg", "é_2.png", "É.png"]
    rows, want = [], {}
    for b in range(150):
        some = rng.sample(pool, rng.randint(1, 7))
        names = [rng.choice(some) for _ in range(rng.randint(1, 14))]
        key = None if b == 0 else f"b{b}"
        rows += [(key, i, n) for i, n in enumerate(names)]
        want |= {(key, i): n for i, n in enumerate(plain_names(names))}
    assert named(spark, rows) == want


def test_a_large_batch_of_one_name_and_one_family(spark):
    """One name many times spans many tasks; a family with gaps is filled in order; names met once stay."""
    names = ["Same.png"] * 3000 + [f"cam_{i}.jpg" for i in range(1000)] + ["cam.jpg"] * 900 + [f"x_{i}.jpg" for i in range(5, 60, 5)] + ["x.jpg"] * 40
    random.Random(1).shuffle(names)
    assert named(spark, [("b", i, n) for i, n in enumerate(names)]) == {("b", i): n for i, n in enumerate(plain_names(names))}


def test_families_keep_names_apart_that_cannot_meet(spark):
    """A camera's numbered names do not meet unless the bare name comes again."""
    names = [("b", f"img_{i}.jpg", 1) for i in range(2, 50)] + [("b", "img.jpg", 1), ("c", "img.jpg", 3), ("c", "img_3.jpg", 1), ("c", "img_9.jpg", 1)]
    got = {(r.b, r.l): r.family for r in sampling._name_families(spark.createDataFrame(names, "b string, l string, n long")).collect()}
    assert got == {("c", "img.jpg"): "img.jpg", ("c", "img_3.jpg"): "img.jpg"}


def test_null_names_and_no_rows(spark):
    assert named(spark, [("b", 0, None), ("b", 1, "x"), ("b", 2, None), ("b", 3, "X")]) == {("b", 0): None, ("b", 1): "x", ("b", 2): None, ("b", 3): "X_2"}
    assert named(spark, []) == {}


def test_numbers_in_groups_that_span_tasks(spark):
    rows = [(g, i) for g in (None, "a", "b", "c") for i in range({"a": 5000, "b": 1}.get(g, 40))]
    random.Random(3).shuffle(rows)
    got = sampling.numbered_within(spark.createDataFrame(rows, "g string, i long"), ["g"], ["i"], "nth").collect()
    assert len(got) == len(rows) and all(r.nth == r.i + 1 for r in got)


def plain_half(queries):
    n = len(queries)
    half, chosen, used = (n + 1) // 2, [], set()
    for k in range(half):
        slot = min(n - 1, (2 * k + 1) * n // (2 * half))
        j = min((j for j in range(n) if j not in chosen), key=lambda j: (queries[j] in used, abs(j - slot), j))
        chosen.append(j)
        used.add(queries[j])
    return sorted(chosen)


def test_half_coverage_against_a_search(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for c in range(120):
        queries = [rng.choice("abcdefghij"[: rng.randint(1, 10)] + "é") for _ in range(rng.randint(1, 25))]
        if c % 7 == 0:
            queries = [None if q == "a" else q for q in queries]
        key = None if c == 5 else c
        rows += [(key, 3 * i, q, "h") for i, q in enumerate(queries)]
        want |= {(key, 3 * j) for j in plain_half(queries)}
    rng.shuffle(rows)
    got = sampling.half_coverage(spark.createDataFrame(rows, "chapter long, para_index int, query string, heading string")).collect()
    assert {(r.chapter, r.para_index) for r in got} == want and len(got) == len(want)


def test_half_coverage_of_one_large_chapter(spark):
    df = spark.range(60_000).selectExpr("1L as chapter", "id as para_index", "cast(id % 20000 as string) as query", "repeat('x', 200) as heading")
    assert sampling.half_coverage(df).count() == 30_000


def plain_greedy(plans, ranked):
    used, out = set(), {}
    for turn, plan in sorted(plans):
        for _, i in sorted(ranked.get(plan, [])):
            if i not in used:
                used.add(i)
                out[plan] = i
                break
    return out


@pytest.mark.parametrize("n", [1, 12, 60])
def test_greedy_choice_against_a_fold(spark, n):
    rng = random.Random(n)
    plans, ranked, want = [], [], {}
    for review in range(8):
        turns = [(rng.randint(0, n // 2), f"p{i}") for i in range(n)]
        lists = {p: [(r, f"c{c}") for r, c in enumerate(rng.sample(range(max(6, n)), rng.randint(0, 5)), 1)] for _, p in turns}
        if review == 0:  # a chain: each plan pushes the next one on
            turns = [(i, f"p{i}") for i in range(n)]
            lists = {f"p{i}": [(1, f"c{i or 1}"), (2, f"c{i + 1}")] for i in range(n)} if n <= 12 else lists
        plans += [(review, p, t) for t, p in turns]
        ranked += [(review, p, c, r) for p, cs in lists.items() for r, c in cs]
        want |= {(review, p): c for p, c in plain_greedy(turns, lists).items()}
    got = sampling.greedy_unique(spark.createDataFrame(plans, "review long, plan string, turn long"), spark.createDataFrame(ranked, "review long, plan string, identifier string, rank int"), "review", "plan", "turn").collect()
    assert {(r.review, r.plan): r.identifier for r in got} == want and len(got) == len(want)
