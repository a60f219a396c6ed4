"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a row of a table: a regular expression over host and path, with the literal tokens that every match must
hold. The tokens' frequencies are counted over all given hosts and paths and each rule is filed under its rarest token. The tokens
of a URL then fetch candidate rules from that index by a join, and only those run their expressions. Everything is a
Spark expression or join; the index is broadcast as long as the rules are few enough, and joined by a shuffle beyond.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import own_columns, settle, unused_name

#: Rules whose index is broadcast, at most.
BROADCAST = 200_000
#: URLs of one place that make it a trap.
TRAP = 3
#: Columns of a table of rules.
RULES = "name string, pattern string, tokens array<string>, verdict string, rank int"
_TOKEN = re.compile(r"[A-Za-z0-9]+")


class Rule(NamedTuple):
    """pattern is matched against host + path; rank decides between several rules that fit (the largest wins)."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def place_rule(place: str, verdict: str) -> Rule:
    """The rule for `host/path`: the host and all its subdomains, paths that start with the rule's; longer wins."""
    host, slash, path = place.partition("/")
    start = path.rpartition("/")[0]  # an unfinished last segment is no whole token
    tokens = tuple(dict.fromkeys(_TOKEN.findall(f"{host}/{start}/")))
    return Rule(place, rf"(?s)\A(?:[^/]*\.)?{re.escape(host + slash + path)}", tokens, verdict, 1000 + len(place))


def word_rule(word: str, verdict: str) -> Rule:
    """A rule for hosts that hold a word as a whole token; places outrank it."""
    return Rule(f"word:{word}", rf"(?s)\A(?:[^/]*[^A-Za-z0-9/])?{re.escape(word)}(?:[^A-Za-z0-9]|\z)", (word,), verdict, len(word))


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(target: Column) -> Column:
    """Distinct runs of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(target, "[^A-Za-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules given in the program as a table; longer lists are read from files with the same columns."""
    return spark.createDataFrame([(r.name, r.pattern, list(r.tokens), r.verdict, r.rank) for r in rules], RULES)


def trap_rules(urls: DataFrame, least: int = TRAP, url: str = "url") -> DataFrame:
    """A table of rules that block each place (host and path) which `least` or more different URLs lead to: addresses
    that differ in their query or fragment alone, as calendars, sessions and sort orders make without end.

    Every other rule outranks them. A place without an ASCII letter or digit gets no rule, as no token could fetch it.
    """
    places = urls.select(F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where("host <> ''").distinct()
    many = places.groupBy("host", "path").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.concat("host", "path")
    literal = F.concat(F.lit(r"(?s)\A\Q"), F.replace(place, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\z"))
    rules = many.select(F.concat(F.lit("trap:"), place).alias("name"), literal.alias("pattern"), tokens_of(place).alias("tokens"), F.lit("block").alias("verdict"), F.lit(0).alias("rank"))
    return rules.where(F.size("tokens") > 0)


def token_index(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, name, pattern, verdict, rank): each rule under that of its tokens which the fewest targets hold.

    targets has a column tokens. A rule met twice is filed once.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = targets.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = rules.distinct().select("name", "pattern", "verdict", "rank", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("length"), "token"))
    return settle(each.groupBy("name", "pattern", "verdict", "rank").agg(rarest.alias("r")).select("r.token", "name", "pattern", "verdict", "rank"))


def candidates(targets: DataFrame, index: DataFrame) -> DataFrame:
    """(host, path, name, pattern, verdict, rank): the rules that the tokens of distinct targets (host, path, tokens) fetch."""
    few = index.count() <= BROADCAST
    asked = targets.select("host", "path", F.explode("tokens").alias("token"))
    return asked.join(F.broadcast(index) if few else index, "token").drop("token")


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """urls with host, path, rule (name, else null) and verdict: of the rules that fit the one with the largest rank,
    then the largest name.

    A null URL, or one without `://`, has an empty host and path, meets no rule and gets the default verdict. Rows are
    judged one by one, so repeated rows and rows with null keys pass through; columns of the same names are replaced. A
    rule without a literal token is refused.
    """
    if not rules.where("coalesce(size(tokens), 0) < 1").isEmpty():
        raise ValueError("a rule has no literal token")
    best = unused_name(urls, "_best")
    parts = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    targets = parts.select("host", "path").where("host <> ''").distinct().withColumn("tokens", tokens_of(F.concat("host", "path")))
    fits = candidates(targets, token_index(targets, rules)).where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    told = fits.groupBy("host", "path").agg(F.max(F.struct("rank", "name", "verdict")).alias(best))
    judged = parts.drop("rule", "verdict").join(told, ["host", "path"], "left")
    out = judged.withColumns({"rule": F.col(f"{best}.name"), "verdict": F.coalesce(f"{best}.verdict", F.lit(default))}).drop(best)
    kept = [c for c, name in zip(own_columns(parts), parts.columns, strict=True) if name.lower() not in ("rule", "verdict")]
    return out.select(*kept, "rule", "verdict")
