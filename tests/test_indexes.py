"""Matching through indexes against plain loops over all pairs."""

import difflib
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from quirelake.operators import matching


def test_every_match_holds_a_required_string():
    assert matching.required_literals("thth|eau") == ["eau", "thth"]
    assert matching.required_literals(r"(?i)\bCare\s+(?:Workers?|homes)\b") == ["homes", "worker"]
    assert matching.required_literals(r"ab?c(?:dEf)+g") == ["def"]
    assert matching.required_literals(r"x{2,3}(?:yy|z)") == ["x"]
    for unknown in ("[a-z]+", "(?:long)?", "a|", r"\p{L}x", "(?iu)k", "[[ab]c]d", "a&&b", "(", r"\Qa.b\E", "(?x) a b", r"\d+"):
        assert matching.required_literals(unknown) is None, unknown


def test_rule_table_against_the_chain(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeio" for c in "mnst"]
    rules = [(i, rng.choice([r"\b{}\b", "{}|{}x", "(?i){}[0-9]?", "{} +{}", "(?:{})?q", "^{}", "[a-c]{}$"]).replace("{}", rng.choice(words)), f"v{i % 50}") for i in range(400)]
    rules += [(1000, None, "none"), (1001, "z$", "end"), (1002, r"[0-9]{3}", "digits")]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "X", "7"]) for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(500, None), (501, "nothing z"), (502, "BAM"), (503, "123 z")]
    got = {r.k: r.value for r in matching.first_rule_of_table(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rules, "rule_order int, pattern string, value string"), "k").collect()}
    want = {}
    for k, t in texts:
        for _, p, v in rules:
            if t is not None and p is not None and re.search(p, t):
                want[k] = v
                break
    assert got == want


def test_a_hundred_thousand_rules(spark, monkeypatch):
    rules = spark.range(100_000).selectExpr("cast(id as int) as rule_order", "concat('\\\\bkey', id * 7, '\\\\b') as pattern", "concat('v', id) as value")
    texts = spark.range(2000).selectExpr("id as k", "concat('some key', id * 21, ' and key', id * 35, ' here') as text")
    got = matching.first_rule_of_table(texts, rules, "k").collect()
    assert {r.k: r.value for r in got} == {i: f"v{3 * i}" for i in range(2000)}
    monkeypatch.setattr(matching, "RULES_AT_ONCE", 150)
    few = matching.first_rule_of_table(texts.where("k < 20"), rules.where("rule_order < 400"), "k").collect()
    assert {r.k: r.value for r in few} == {i: f"v{3 * i}" for i in range(20)}


def test_no_rules_and_no_texts(spark):
    texts, rules = spark.createDataFrame([(1, "a")], "k long, text string"), spark.createDataFrame([], "rule_order int, pattern string, value string")
    assert matching.first_rule_of_table(texts, rules, "k").count() == 0
    assert matching.first_rule_of_table(texts.limit(0), spark.createDataFrame([(1, "a", "b")], rules.schema), "k").count() == 0


def score(target, other):
    if target == other:
        return 1.0
    mine, theirs = set(target.split("-")), set(other.split("-"))
    return 0.7 * difflib.SequenceMatcher(None, target, other).ratio() + 0.3 * len(mine & theirs) / len(mine)


@pytest.mark.parametrize("least", [0.88, 0.75])
def test_replacements_against_all_pairs(spark, least):
    rng = random.Random(11)
    words = "real estate property business office people plant green red blue vector photo flat set icon team".split()
    catalogue, retired = [], []
    for i in range(250):
        base = [rng.choice(words) for _ in range(rng.randint(1, 8))]
        catalogue += [(i // 2, "-".join(base))] * rng.randint(1, 2)
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] += rng.choice(["s", "", "x"])
            retired.append((rng.randint(0, 130), "-".join(base)))
    retired += [(900 + i, "red-plate") for i in range(40)] + [(950, "")]
    catalogue += [(900 + i, "red-plate") for i in range(40)]
    want = {}
    for i, slug in retired:
        best = min(((-score(slug, o), j) for j, o in catalogue if j != i and slug), default=None)
        if best and -best[0] >= least:
            want[i, slug] = (best[1], round(-best[0], 9))
    got = matching.replacements(spark.createDataFrame(retired, "id long, slug string"), spark.createDataFrame(catalogue, "other_id long, other_slug string"), least).collect()
    assert {(r.id, r.slug): (r.other_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)
    assert sum(least <= s < 1 for _, s in want.values()) > 5


@pytest.mark.parametrize(("least", "signed", "piece"), [(0.88, 16, 1000), (0.88, 6, 2), (0.75, 16, 3), (0.5, 5, 1000)])
def test_similar_slugs_against_all_pairs(spark, monkeypatch, least, signed, piece):
    """Words that are joined, cut, swapped, doubled, left out or of one letter, in short and long slugs; pairs must share a word, as ever."""
    monkeypatch.setattr(matching, "SIGNED", signed)
    monkeypatch.setattr(matching, "PIECE", piece)
    rng = random.Random(23)
    words = "a of in the real estate property business office people plant green red blue vector photograph flat set icon team".split()
    known = {"-".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 6, 8, 8, 12, 20]))) for _ in range(150)}

    def changed(slug):
        parts = slug.split("-")
        at = rng.randrange(len(parts))
        other = rng.randrange(len(parts))
        parts[at] = rng.choice([parts[at] + "s", parts[at][1:], parts[at] + parts[other], parts[at] + "-" + parts[at], parts[other], "a-" + parts[at], parts[at] + "zzz"])
        return re.sub("-+", "-", "-".join(parts)).strip("-") if rng.random() < 0.5 else re.sub("-+", "-", "-".join(parts)).replace("-", "", 1).strip("-")

    asked = {changed(s) for s in known} | {changed(changed(s)) for s in known} | {changed(changed(changed(s))) for s in known}
    asked.discard("")
    want = {(a, b): round(score(a, b), 9) for a in asked for b in known if a != b and set(a.split("-")) & set(b.split("-")) and score(a, b) >= least}
    rows = matching.similar_slugs(spark.createDataFrame([(s,) for s in sorted(asked)], "slug string"), spark.createDataFrame([(s,) for s in sorted(known)], "other_slug string"), least).collect()
    assert {(r.slug, r.other_slug): round(r.score, 9) for r in rows} == want and len(rows) == len(want) > 100


def test_slugs_of_few_common_words_are_not_all_paired(spark):
    """Each word is in one slug of eight: pairs that share one word are far too many for a minute, those that share three are not."""
    word = lambda k: f"concat('common', substr(sha2(concat(id, '/{k}'), 256), 1, 1), substr('0123', 1 + ascii(substr(sha2(concat(id, '/{k}'), 256), 2, 1)) % 4, 1))"
    slugs = spark.range(30_000).selectExpr("id", f"concat_ws('-', {', '.join(map(word, range(8)))}) as slug")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = matching.similar_slugs(slugs.where("id % 2 = 0").selectExpr("regexp_replace(slug, '.$', 'x') as slug"), slugs.selectExpr("slug as other_slug"), 0.88).select("slug", "other_slug").collect()
    finally:
        timer.cancel()
    assert sum(a[:-1] == b[:-1] for a, b in got) >= 15_000


def test_the_best_of_three_slugs_counts(spark):
    items = [
        (1, "https://s.example/free-vector/real-estate-business-assessment_99.htm", None, "Real estate, business & assessment"),
        (2, "https://s.example/x_5.htm", "Real Estate Business Assessments", None), (3, None, None, "beach"), (4, None, "", "!!"),
    ]
    slugs = matching.catalogue_slugs(spark.createDataFrame(items, "id long, url string, slug string, title string"), F.col("title"))
    assert sorted((r.other_id, r.other_slug) for r in slugs.collect()) == [(1, "real-estate-business-assessment"), (2, "real-estate-business-assessments"), (2, "x"), (3, "beach")]
    asked = spark.createDataFrame([(7, "real-estate-business-assessment"), (1, "real-estate-business-assessment"), (8, "unrelated-beach-photograph")], "id long, slug string")
    got = {r.id: (r.other_id, r.score) for r in matching.replacements(asked, slugs).collect()}
    assert got[7] == (1, 1.0) and got[1][0] == 2 and 0.88 <= got[1][1] < 1 and 8 not in got


def plain_cover(title, covers):
    if len(covers) == 1:
        return covers[0][1]
    word = title.strip().split()[-1].lower() if title and title.strip() else ""
    return next((c for _, c in sorted(covers, key=lambda x: x[0]) if word and c is not None and word in c.lower()), None)


def test_covers_against_a_loop(spark):
    rng = random.Random(3)
    bits = ["Unit", "Care", "é", "Work", "ab", "x", "Health and Safety", "hea", "lth", " "]
    covers = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))) for i in range(200)] + [(900, None)]
    titles = [(i, rng.choice(["My ", "", " "]) + "".join(rng.choice([*bits, "zz"]) for _ in range(rng.randint(0, 3)))) for i in range(300)] + [(999, None)]
    for some in (covers, covers[:1], []):
        got = {r.k: r.cover for r in matching.title_covers(spark.createDataFrame(titles, "k long, title string"), spark.createDataFrame(some, "pos long, cover string"), "k").collect()}
        want = {k: plain_cover(t, some) for k, t in titles}
        assert {k: c for k, c in got.items() if c is not None} == {k: c for k, c in want.items() if c is not None}


def test_a_hundred_thousand_covers(spark):
    covers = spark.range(100_000).selectExpr("id as pos", "concat('The common cover number', id, ' end') as cover")
    titles = spark.range(500).selectExpr("id as k", "case when id % 5 = 0 then 'a common' when id % 5 = 1 then 'b end' when id % 5 = 2 then 'no commons' else concat('see number', id * 100) end as title")
    got = {r.k: r.cover for r in matching.title_covers(titles, covers, "k").collect()}
    def first(n):
        return next(j for j in range(100_000) if str(j).startswith(str(n)))
    want = {i: 0 if i % 5 < 2 else first(i * 100) for i in range(500) if i % 5 != 2}
    assert {k: int(re.search(r"number(\d+)", c).group(1)) for k, c in got.items()} == want
