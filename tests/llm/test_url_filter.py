import re

import pytest
from pyspark.sql import functions as F

from quirelake.llm import queries
from quirelake.llm import url_filter as uf

URLS = [
    "http://a.net/x", "http://net/", "http://net", "https://en.example.net/en/1?x=/en/", "http://example.net/EN/1", "http://badexample.net/en/", None, "",
    "no scheme", "http://", "HTTP://X.ORG/fr/a", "ftp://u:p@b.org/fr/", "http://b.org:80/fr/", "x://y://z.net/q", "http://www.Cheap-PILLS.example.com/en", "http://example.com/de/#a",
    "http://sub.example.com/de/x", "http://pillsbury.com/", "http://a.net\n/x", "http://ünet/", "http://a.b.org/fr", "http://xn.net?/", "http://casino", "http://x.com/casino",
    *[f"http://cal.example.org/day?d={i}" for i in range(3)], "http://cal.example.org/day#x", "http://cal.example.org/day/", "http://two.org/a?1", "http://two.org/a?2", "http://two.org/a?2",
    *[f"https://a.b.org/fr/x?{i}" for i in range(4)], *[f"http://q.com/\\E.*?{i}" for i in range(3)], "http://q.com/\\Ezz", *[f"http://é.é/?{i}" for i in range(3)], *[f"http://?{i}" for i in range(3)],
]


def split(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, path


def judged(url):
    """(host, path, rule, verdict) by plain Python."""
    host, path = split(url)
    fits = []
    for place, verdict in queries.PLACES:
        h, _, p = place.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(place), place, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    same = len({u for u in URLS if u and split(u) == (host, path)})
    trap = host and re.search("[A-Za-z0-9]", host + path) and same >= uf.TRAP
    return host, path, None, "block" if trap else "allow"


def test_query_against_plain_python(spark, tmp_path):
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.host, r.path, r.rule, r["verdict"]) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}


def test_only_fetched_rules_run(spark, monkeypatch):
    rules = uf.rule_table(spark, [uf.word_rule(f"word{i}", "block") for i in range(5000)] + [uf.place_rule("com/a/", "allow")])
    df = spark.createDataFrame([("http://word7.com/", 1), ("http://x.com/a/b", 2), ("http://word7.com/", 1), ("http://x.org", 3)], "url string, host int")
    rows = uf.filter_urls(df, rules).collect()
    assert sorted((r.host, r["verdict"], r.rule) for r in rows) == sorted([("word7.com", "block", "word:word7")] * 2 + [("x.com", "allow", "com/a/"), ("x.org", "allow", None)], key=str)
    targets = df.select(uf.host_of(F.col("url")).alias("host"), uf.path_of(F.col("url")).alias("path")).distinct().withColumn("tokens", uf.tokens_of(F.concat("host", "path")))
    index = uf.token_index(targets, rules)
    assert index.count() == 5001 and index.where("name = 'com/a/'").first().token == "a"
    assert sorted((r.host, r.name) for r in uf.candidates(targets, index).collect()) == [("word7.com", "word:word7"), ("x.com", "com/a/")]
    monkeypatch.setattr(uf, "BROADCAST", 10)
    assert sorted(map(str, uf.filter_urls(df, rules).collect())) == sorted(map(str, rows))
    assert uf.filter_urls(df, uf.rule_table(spark, [])).where("verdict = 'allow'").count() == 4
    assert uf.filter_urls(df.limit(0), rules).count() == 0


def test_clashing_columns_and_rules_without_a_token(spark):
    df = spark.createDataFrame([("http://a.net/x", 1, 2, 3)], "url string, _best int, tokens int, rule int")
    out = uf.filter_urls(df, uf.rule_table(spark, [uf.place_rule("net/", "block")]))
    assert out.columns == ["url", "_best", "tokens", "host", "path", "rule", "verdict"] and out.first().tokens == 2
    with pytest.raises(ValueError, match="token"):
        uf.filter_urls(df, uf.rule_table(spark, [uf.Rule("r", ".", (), "block", 1)]))


def test_no_python_on_the_main_path(spark):
    plan = queries.op2_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_traps_are_rules_of_the_data(spark):
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    rules = {r.name: r for r in uf.trap_rules(urls).collect()}
    assert set(rules) == {"trap:cal.example.org/day", "trap:a.b.org/fr/x", "trap:q.com/\\E.*"}
    assert rules["trap:cal.example.org/day"].tokens == ["cal", "example", "org", "day"] and {r["verdict"] for r in rules.values()} == {"block"}


def test_column_names_with_dots(spark):
    urls = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string").withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    out = uf.filter_urls(urls, uf.rule_table(spark, [uf.place_rule("net/", "block")]))
    assert out.columns == ["page_id", "url", "a.b", "c`d", "host", "path", "rule", "verdict"] and out.first()["verdict"] == "block"
