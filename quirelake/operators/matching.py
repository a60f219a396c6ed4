"""Reconciliation and matching between tables."""

from __future__ import annotations

import difflib
import re
import re._constants as sre_constants
import re._parser as sre
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quirelake.operators.durable import settle


def pick_per_number(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One file for each number of a batch: numeric names first, then jpg, jpeg, png, then by name."""
    from quirelake.functions import text as tx

    base = F.trim(F.lower(tx.stem(F.col("filename"))))
    kind = tx.suffix(F.col("filename"))
    rank = F.when(kind == ".jpg", 0).when(kind == ".jpeg", 1).when(kind == ".png", 2).otherwise(9)
    order = W.partitionBy(batch, "number").orderBy(F.when(base.rlike(r"^\d*[1-9]\d*$"), 0).otherwise(1), rank, F.lower("filename"), "filename", "file_id")
    return files.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def placements(wanted: DataFrame, chosen: DataFrame) -> DataFrame:
    """wanted (doc_id, pos, number) with the chosen file of its number, null where there is none."""
    return wanted.join(chosen.selectExpr("batch_id AS doc_id", "number", "filename"), ["doc_id", "number"], "left")


def missing_and_unused(wanted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, number, side): numbers wanted without a file (`missing`), and with a file but not wanted (`unused`)."""
    have = chosen.selectExpr("batch_id AS doc_id", "number")
    ask = wanted.select("doc_id", "number").distinct()
    missing = ask.join(have, ["doc_id", "number"], "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(have.join(ask, ["doc_id", "number"], "left_anti").withColumn("side", F.lit("unused")))


def nth_anchor(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (doc_id, pos, url, number, label) with anchor, the para_index they belong to.

    The k-th link of a URL goes to the k-th anchor (doc_id, para_index, url, text) of that URL; the first one rather to
    an anchor whose text names its number; without either to a paragraph whose text is the label, if that is the only
    one, else to the next of equal ones.
    """
    k = F.row_number().over(W.partitionBy("doc_id", "url").orderBy("pos"))
    mine = links.withColumn("k", k)
    place = anchors.where("url IS NOT NULL").withColumn("k", F.row_number().over(W.partitionBy("doc_id", "url").orderBy("para_index")))
    by_url = place.select("doc_id", "url", "k", F.col("para_index").alias("a_url"))
    named = mine.where("k = 1 AND number IS NOT NULL").join(place.select("doc_id", "url", "para_index", "text"), ["doc_id", "url"])
    hit = F.regexp_like("text", F.concat(F.lit(r"(?i)\bimage\s*[-:#]?\s*0*"), F.col("number").cast("string"), F.lit(r"\b")))
    by_number = named.where(hit).groupBy("doc_id", "pos").agg(F.min("para_index").alias("a_number"))
    same = W.partitionBy("doc_id", "label").orderBy("pos")
    lines = anchors.where("text <> ''").withColumn("j", F.row_number().over(W.partitionBy("doc_id", "text").orderBy("para_index")))
    by_text = lines.select("doc_id", F.col("text").alias("label"), "j", F.col("para_index").alias("a_text"))
    out = mine.withColumn("j", F.row_number().over(same)).join(by_url, ["doc_id", "url", "k"], "left").join(by_number, ["doc_id", "pos"], "left").join(by_text, ["doc_id", "label", "j"], "left")
    return out.withColumn("anchor", F.coalesce("a_number", "a_url", "a_text")).drop("k", "j", "a_url", "a_number", "a_text")


def two_hop(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, middle: str, value: str, default: str) -> DataFrame:
    """rows with value, looked up by key in first (key, middle) and by middle in second (middle, value); else default."""
    return rows.join(first.select(key, middle), key, "left").join(second.select(middle, value), middle, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def survival(inserted: DataFrame, draws: DataFrame, media: DataFrame) -> DataFrame:
    """Per document how many inserted ids (doc_id, rid) still have a draw and a medium, and which were lost."""
    n = draws.groupBy("doc_id", "rid").agg(F.count("*").alias("n_draws"))
    there = media.select("doc_id", "rid").distinct().withColumn("_there", F.lit(True))
    out = inserted.join(n, ["doc_id", "rid"], "left").join(there, ["doc_id", "rid"], "left")
    alive = (F.coalesce("n_draws", F.lit(0)) > 0) & F.coalesce("_there", F.lit(False))
    lost = F.array_join(F.sort_array(F.collect_list(F.when(~alive, F.col("rid")))), ",")
    return out.groupBy("doc_id").agg(F.count_if(alive).alias("survived"), lost.alias("lost"))


def with_override(links: DataFrame, manual: DataFrame) -> DataFrame:
    """links with status: `manual` where the document gives a file for their number by hand, else `link`."""
    by_hand = links.join(manual, ["doc_id", "number"], "left_semi").withColumn("status", F.lit("manual"))
    return by_hand.unionByName(links.join(manual, ["doc_id", "number"], "left_anti").withColumn("status", F.lit("link")))


def first_rule(rows: DataFrame, rules: list[tuple[str, str]], column: str = "text", name: str = "rule") -> DataFrame:
    """rows with the name of the first (name, pattern) rule that hits column, else null. Rules are fixed, so they are
    one chain of conditions and no join."""
    out: Column = F.lit(None).cast("string")
    for value, pattern in reversed(rules):
        out = F.when(F.col(column).rlike(pattern), F.lit(value)).otherwise(out)
    return rows.withColumn(name, out)


def required_literals(pattern: str) -> list[str] | None:
    """Lower-cased strings of which each match of a regular expression holds one at least, as long as can be told; null
    where no such strings are known (or the expression is not read here), so that it must be tried on every text."""
    try:
        parsed = sre.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    if parsed.state.flags & (re.VERBOSE | re.LOCALE) or re.search(r"\(\?[a-z]*[uUx]|\\[Q0]|&&|\[[^\]]*\[", pattern):
        return None

    def best(items) -> list[str] | None:
        """The most telling set of strings of a sequence: the one whose shortest string is longest."""
        options: list[list[str]] = []
        run = ""

        def closed() -> None:
            nonlocal run
            if run:
                options.append([run])
            run = ""

        for kind, value in items:
            if kind is sre_constants.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if kind is sre_constants.AT:  # takes no characters, but a string may not go on over it in every reading
                closed()
                continue
            closed()
            inner = None
            if kind is sre_constants.SUBPATTERN:
                inner = best(value[-1])
            elif kind in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT, sre_constants.POSSESSIVE_REPEAT) and value[0] >= 1:
                inner = best(value[2])
            elif kind is sre_constants.ATOMIC_GROUP:
                inner = best(value)
            elif kind is sre_constants.BRANCH:
                ways = [best(way) for way in value[1]]
                inner = sorted({s for way in ways for s in way}) if all(ways) else None
            if inner:
                options.append(inner)
        closed()
        return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    return best(parsed)


#: Rules whose strings one automaton holds; more are met in several passes.
RULES_AT_ONCE = 200_000


def first_rule_of_table(rows: DataFrame, rules: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, value): as first_rule, for a table of rules (rule_order, pattern, value) of any size.

    Each rule is known by strings of which every match holds one. One multi-pattern automaton a task finds these in a
    text and so fetches the rules worth trying; only they are run, in the engine's own regular expressions. Rules without
    such strings are tried on each text: a short list in a table of literal words. Of several hits the smallest
    rule_order counts. A null text meets no rule; rows of the same key are one.
    """
    spark = rows.sparkSession

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def literals(patterns: pa.Array) -> pa.Array:
        return pa.array([None if p is None else required_literals(p) for p in patterns.to_pylist()], pa.list_(pa.string()))

    known = settle(rules.where("pattern is not null").select("rule_order", "pattern", "value", literals("pattern").alias("words")))
    texts = rows.select(key, F.col(column).alias("_text")).where("_text is not null")
    hits = []
    loose = known.where("words is null").drop("words")
    if not loose.isEmpty():
        hits.append(texts.join(F.broadcast(loose), F.expr("_text rlike pattern")).select(key, "rule_order", "value"))
    telling = known.where("words is not null")
    passes = -(-telling.count() // RULES_AT_ONCE)
    for turn in range(passes):
        part = telling.where(F.pmod(F.xxhash64("rule_order", "pattern"), F.lit(passes)) == turn)
        chosen = part.withColumn("_at", F.xxhash64("rule_order", "pattern", "value"))
        words = chosen.select(F.explode("words").alias("w"), "_at").groupBy("w").agg(F.collect_set("_at").alias("at"))
        fetched = _with_words(texts, [(r["w"], r["at"]) for r in words.collect()], "_at")
        hits.append(fetched.join(chosen.drop("words"), "_at").where(F.expr("_text rlike pattern")).select(key, "rule_order", "value"))
    if not hits:
        return texts.select(key, F.lit(None).cast("string").alias("value")).where(F.lit(False))
    return reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.min_by("value", "rule_order").alias("value"))


def _with_words(texts: DataFrame, words: list[tuple[str, list[int]]], name: str) -> DataFrame:
    """texts (with _text) once for each number that the words given lead to, where the text holds the word in any case."""
    given = texts.sparkSession.sparkContext.broadcast(words)
    place = texts.columns.index("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word, numbers in given.value:
            automaton.add_word(word, numbers)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({n for _, numbers in automaton.iter(text.as_py().lower()) for n in numbers}) for text in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, name])

    met = texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))
    return met.withColumn(name, F.explode(name))


def stale_plans(plans: DataFrame, par: DataFrame) -> DataFrame:
    """Per chapter whether every plan's paragraph still carries its heading."""
    from quirelake.functions import text as tx

    now = par.select(F.col("doc_id").alias("chapter"), "para_index", tx.collapsed(F.col("text")).alias("_now"))
    met = plans.join(now, ["chapter", "para_index"], "left").withColumn("_ok", F.coalesce(F.col("_now").eqNullSafe(tx.collapsed(F.col("heading"))), F.lit(False)))
    return met.groupBy("chapter").agg(F.bool_and("_ok").alias("valid"), F.count_if(~F.col("_ok")).alias("n_stale"))


def approved(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key was chosen."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def unused_candidates(cand: DataFrame, used: DataFrame) -> DataFrame:
    """The candidates that no earlier batch used."""
    return cand.join(used.select("identifier").distinct(), "identifier", "left_anti")


def overlaid(original: DataFrame, edited: DataFrame, key: str, value: str) -> DataFrame:
    """original with the value of edited rows of the same key; others pass through."""
    new = edited.select(key, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return original.join(new, key, "left").withColumn("edited", F.coalesce("_hit", F.lit(False))).withColumn(value, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_hit")


def _slice(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def _pointers(times: DataFrame, life: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct times (k, at): (k, at, next), the first time more than `life` after each that has one; and the times (k, at)
    with none in the `life` before them.

    Times are cut into slices of `width`. What is looked for stands in a slice that is known, or else first (last) in the
    next (previous) slice that holds any time, so that the times of a hot key spread over as many tasks as it has slices.
    """
    cut = times.withColumn("slice", _slice(F.col("at"), width))
    slices = settle(cut.groupBy("k", "slice").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    order = W.partitionBy("k").orderBy("slice")
    before = slices.select("k", "slice", F.lag("last").over(order).alias("before"))
    inner = cut.withColumn("prev", F.lag("at").over(W.partitionBy("k", "slice").orderBy("at"))).join(before, ["k", "slice"])
    prev = F.coalesce("prev", "before")
    heads = inner.where(prev.isNull() | (F.col("at") - prev > life)).select("k", "at")
    none = F.lit(None).cast("long")
    probes = times.select("k", (F.col("at") + life).alias("t"), F.col("at").alias("own"), none.alias("there"))
    marks = times.select("k", F.col("at").alias("t"), none.alias("own"), F.col("at").alias("there"))
    both = probes.unionByName(marks).withColumn("slice", _slice(F.col("t"), width))
    # from a slice's end backwards, what was met last comes next; a probe stands before the mark of the same time, as it asks for later ones
    back = W.partitionBy("k", "slice").orderBy(F.desc("t"), F.desc_nulls_last("own")).rowsBetween(W.unboundedPreceding, 0)
    asked = both.withColumn("near", F.last("there", ignorenulls=True).over(back)).where("own is not null").select("k", "slice", "own", "near")
    places = slices.select("k", "slice", "first").unionByName(asked.where("near is null").select("k", "slice", none.alias("first")))
    places = places.groupBy("k", "slice").agg(F.max("first").alias("first"))
    far = places.select("k", "slice", F.first("first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("far"))
    links = asked.join(far, ["k", "slice"], "left").select("k", F.col("own").alias("at"), F.coalesce("near", "far").alias("next"))
    return links.where("next is not null"), heads


def served_from_store(requests: DataFrame, hours: int = 24, width: int = 3600) -> DataFrame:
    """requests (key, ts, id) with saved_at: the time of the answer that serves them; null where ts is null.

    A request within `hours` of the last saved answer of its key is a hit and does not renew it; any other is asked
    anew and saved. Each time points to the first one that its answer would not serve. A time with no other in the
    `hours` before it is always saved, and from these pointers lead to all others that are. They are followed by doubling: after
    k joins all saved ones up to 2 ** k pointers away are marked. A request then finds its answer in its own stretch of
    `hours` or the one before; a stretch holds one at most. No key is gathered: joins and windows go by slices of `width`
    seconds. A null key is a key.
    """
    life = hours * 3_600_000_000
    rows = requests.withColumns({"_k": F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")), "_at": F.unix_micros(F.col("ts").cast("timestamp"))})
    times = settle(rows.where("_at is not null").groupBy(F.col("_k").alias("k"), F.col("_at").alias("at")).agg(F.min("ts").alias("ts")))
    links, heads = _pointers(times.select("k", "at"), life, width * 1_000_000)
    saved = settle(heads)
    jump = settle(links.join(saved.withColumnRenamed("at", "next"), ["k", "next"], "left_anti"))  # a head is marked without them
    while not jump.isEmpty():
        met = saved.join(jump, ["k", "at"]).select("k", F.col("next").alias("at"))
        saved = settle(saved.unionByName(met).distinct())
        ahead = jump.select("k", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = settle(jump.join(ahead, ["k", "next"]).select("k", "at", F.col("then").alias("next")))
    answers = saved.join(times, ["k", "at"]).select("k", _slice(F.col("at"), life).alias("part"), F.struct("at", "ts").alias("a"))
    ahead = answers.select("k", (F.col("part") + 1).alias("part"), F.col("a").alias("before"))
    known = answers.withColumnRenamed("a", "own").join(ahead, ["k", "part"], "full").withColumnsRenamed({"k": "_k", "part": "_part"})
    met = rows.withColumn("_part", _slice(F.col("_at"), life)).join(known, ["_k", "_part"], "left")
    serves = F.when(F.col("own.at") <= F.col("_at"), F.col("own.ts")).otherwise(F.col("before.ts"))
    return met.select(*[F.col(f"`{c}`") for c in requests.columns], serves.alias("saved_at"))


def latest_within(left: DataFrame, right: DataFrame, key: str, hours: int, width: int = 3600) -> DataFrame:
    """left (key, ts) with found: the latest ts of right (key, ts) at or before it within `hours`; equal rows of left
    stay apart.

    Both sides are dealt by key and slices of `width` seconds, so that a hot key's rows spread. The latest of right is
    one met before in the order of a slice, or else the last of the nearest slice before that holds any.
    """
    slice_ = _slice(F.unix_micros(F.col("ts").cast("timestamp")), width * 1_000_000)
    none = F.lit(None).cast(right.schema["ts"].dataType)
    asked = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.col(f"`{key}`").alias("_k"), F.col("ts").alias("_t"), slice_.alias("_slice"), none.alias("_mark"))
    marks = settle(right.where(F.col(f"`{key}`").isNotNull() & F.col("ts").isNotNull()).select(F.col(f"`{key}`").alias("_k"), F.col("ts").alias("_t"), slice_.alias("_slice")).distinct())
    both = asked.unionByName(marks.withColumn("_mark", F.col("_t")), allowMissingColumns=True)
    # a range takes in all of the same time, marks as well
    near = F.max("_mark").over(W.partitionBy("_k", "_slice").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow))
    met = both.withColumn("_near", near).where("_row is not null")
    slices = marks.groupBy("_k", "_slice").agg(F.max("_t").alias("_last"))
    places = slices.unionByName(asked.select("_k", "_slice", none.alias("_last")).distinct()).groupBy("_k", "_slice").agg(F.max("_last").alias("_last"))
    far = places.select("_k", "_slice", F.max("_last").over(W.partitionBy("_k").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_far"))
    latest = met.join(far, ["_k", "_slice"], "left").withColumn("_found", F.coalesce("_near", "_far"))
    fits = F.col("_found") >= F.col("_t") - F.make_dt_interval(hours=F.lit(hours))
    return latest.select("_row.*", F.when(fits, F.col("_found")).alias("found"))


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """The matching-blocks ratio of two strings, 0 to 1."""
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def most_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """What sequence_ratio cannot exceed: twice the characters that two strings have in common, as often as both have them, over both lengths."""
    counts: dict[str, Counter] = {}

    def counted(text: str) -> Counter:
        if text not in counts:
            counts[text] = Counter(text)
        return counts[text]

    def most(x: str, y: str) -> float:
        return 2 * (counted(x) & counted(y)).total() / ((len(x) + len(y)) or 1)

    return pa.array([None if x is None or y is None else most(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def catalogue_slugs(items: DataFrame, title: Column, url: str = "url", own: str = "slug") -> DataFrame:
    """(other_id, other_slug): the up to three slugs that each item (id, URL, slug, title) is known by: of its address, its own, of its title."""
    from quirelake.functions import urls

    known = F.array_distinct(F.array_compact(F.array(urls.resource_slug(F.col(url)), urls.slug(F.col(own)), urls.slug(title))))
    return items.select(F.col("id").alias("other_id"), F.explode(known).alias("other_slug")).where("other_slug <> ''")


def _other_than(ids: Column, own: Column) -> Column:
    """Of the one or two smallest ids the first that is not own; null if there is none."""
    return F.get(F.filter(ids, lambda i: ~i.eqNullSafe(own)), F.lit(0))


#: Words of a slug up to which it is known by any three of them; and slugs known by the same three that are met in one piece.
SIGNED, PIECE = 16, 100


def _threes(words: Column) -> Column:
    """All choices of three of an array's values, in their order."""
    after = lambda at: F.slice(words, at, F.size(words))
    return F.flatten(F.transform(words, lambda x, i: F.flatten(F.transform(after(i + 2), lambda y, j: F.transform(after(i + j + 3), lambda z: F.array(x, y, z))))))


def similar_slugs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(slug, other_slug, score) of the pairs of distinct, unequal slugs that reach `least`.

    Score: 0.7 * sequence ratio + 0.3 * share of the slug's words that the other has. Of two words that the other lacks
    one character at least is no part of the sequence, so length and number of words tell how many it may lack; those
    in no slug of the catalogue are counted at once. Of the others, the rarest in the catalogue first, three that both
    have stand among the first of that many and three more, and propose the pair: the first three that both have, so that it
    comes once. A slug that needs fewer than three words, or meets one of more than SIGNED, is proposed by single words. A
    ratio cannot exceed what lengths, words, then counts of characters allow, and only pairs that still can reach the
    mark are compared.
    """
    words = lambda c: F.array_distinct(F.split(c, "-"))
    postings = right.select("other_slug", F.explode(words(F.col("other_slug"))).alias("word"))
    often = postings.groupBy("word").agg(F.count("*").alias("_often"))
    ranked = left.select("slug", F.explode(words(F.col("slug"))).alias("word")).join(often, "word", "left")
    ranked = ranked.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "word"))).alias("_ranked"))
    ratio = max(least - 0.3, 0) / 0.7
    n, known = F.size("_ranked"), F.size(F.filter("_ranked", lambda w: w["n"] > 0))
    able = lambda u: 0.7 * (1 - F.ceil(u / 2) * F.lit(ratio) / (2 * F.length("slug"))) + 0.3 * (1 - u / n) >= least - 1e-9
    lacks = F.least(n - 1, F.size(F.filter(F.sequence(F.lit(1), n), able)))
    asked = ranked.select("slug", F.transform("_ranked", lambda w: w["word"]).alias("_words"), lacks.alias("_lacks"), (n - known).alias("_absent"))
    asked = settle(asked.where("_absent <= _lacks").withColumn("_need", F.size("_words") - F.col("_lacks")))
    first = lambda more: F.slice("_words", F.col("_absent") + 1, F.col("_lacks") - F.col("_absent") + more)
    name = lambda three: F.xxhash64(F.array_join(F.array_sort(three), "-"))
    wanted = asked.where(F.col("_need").between(3, SIGNED)).select("slug", "_words", F.explode(_threes(first(3))).alias("_by")).withColumn("_name", name(F.col("_by")))
    offered = right.where(F.size(words(F.col("other_slug"))) <= SIGNED).select("other_slug", F.explode(F.transform(_threes(words(F.col("other_slug"))), name)).alias("_name"))
    hot = settle(offered.groupBy("_name").agg(F.ceil(F.count("*") / PIECE).alias("_pieces")).where("_pieces > 1"))
    pieces = F.coalesce("_pieces", F.lit(1).cast("long"))
    wanted = wanted.join(hot, "_name", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("_pieces")
    offered = offered.join(hot, "_name", "left").withColumn("_piece", F.pmod(F.xxhash64("other_slug"), pieces)).drop("_pieces")
    by_three = wanted.join(offered, ["_name", "_piece"]).select("slug", "other_slug", "_words", "_by")
    single = asked.select("slug", "_words", "_need", F.explode(first(1)).alias("word"))
    long = postings.where(F.size(words(F.col("other_slug"))) > SIGNED)
    by_one = single.where("_need < 3").join(postings, "word").unionByName(single.where("_need >= 3").join(long, "word"))
    pairs = by_three.unionByName(by_one.select("slug", "other_slug", "_words", F.array("word").alias("_by"))).where("slug <> other_slug")
    pairs = pairs.withColumn("_both", F.array_intersect("_words", words(F.col("other_slug")))).where(F.slice("_both", 1, F.size("_by")) == F.col("_by"))
    share, lengths = F.size("_both") / F.size("_words"), F.length("slug") + F.length("other_slug")
    lost = F.greatest(F.size("_words"), F.size(words(F.col("other_slug")))) - F.size("_both")
    most = F.least(2 * F.least(F.length("slug"), F.length("other_slug")) / lengths, 1 - F.ceil(lost / 2) / lengths)
    near = pairs.withColumn("_share", share).where(0.7 * most + 0.3 * F.col("_share") >= least - 1e-9).select("slug", "other_slug", "_share")
    near = near.withColumn("_most", most_ratio("slug", "other_slug")).where(0.7 * F.col("_most") + 0.3 * F.col("_share") >= least - 1e-9)
    return near.withColumn("score", 0.7 * sequence_ratio("slug", "other_slug") + 0.3 * F.col("_share")).where(F.col("score") >= least).select("slug", "other_slug", "score")


def replacements(retired: DataFrame, catalogue: DataFrame, least: float = 0.88) -> DataFrame:
    """(id, slug, other_id, score): the best catalogue row (other_id, other_slug) for each retired one (id, slug).

    An item may have several slugs, the best counts. Score: 1 for an equal slug, else as in similar_slugs; rows of the
    same id are no match, and less than `least` is none. Of equal scores the smallest other_id wins. Slugs are compared
    once each, however many rows have them: a slug stands for the two smallest ids that have it, as one of them may be
    the retired row itself.
    """
    first = catalogue.groupBy("other_slug").agg(F.min("other_id").alias("_a"))
    second = catalogue.join(first, "other_slug").where("other_id <> _a").groupBy("other_slug").agg(F.min("other_id").alias("_b"))
    nodes = settle(first.join(second, "other_slug", "left").select("other_slug", F.array_compact(F.array("_a", "_b")).alias("_ids")))
    asked = settle(retired.select("id", "slug").where("slug <> ''").distinct())
    equal = asked.join(nodes, F.col("slug") == F.col("other_slug"), "left").select("id", "slug", _other_than(F.col("_ids"), F.col("id")).alias("other_id"))
    equal = settle(equal)
    open_ = equal.where("other_id is null").select("id", "slug")
    near = settle(similar_slugs(open_.select("slug").distinct(), nodes.select("other_slug"), least))
    found = open_.join(near, "slug").join(nodes, "other_slug").select("id", "slug", _other_than(F.col("_ids"), F.col("id")).alias("other_id"), "score")
    best = found.where("other_id is not null").groupBy("id", "slug").agg(F.min(F.struct((-F.col("score")).alias("_less"), "other_id")).alias("_best"))
    best = best.select("id", "slug", "_best.other_id", (-F.col("_best._less")).alias("score"))
    return equal.where("other_id is not null").withColumn("score", F.lit(1.0)).unionByName(best)


#: Covers looked at first for each word, in their order; words that none of them holds look at all that may.
FIRST_COVERS = 64


def title_covers(titles: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """(key, cover): the first cover (pos, cover) whose lower-cased name holds the title's last word; one cover alone
    serves all. pos tells covers apart.

    Covers are indexed by the strings of one, two and three characters in them. A word of up to three is such a string,
    whose first cover is known; of a longer word the rarest three propose, by their first covers and, where none of
    these holds the word, by all. Words are looked up once each, however many titles end in them.
    """
    few = covers.limit(2).collect()
    if len(few) == 1:
        return titles.select(key, F.lit(few[0]["cover"]).cast("string").alias("cover"))
    word = F.lower(F.element_at(F.split(F.trim("title"), r"\s+"), -1))
    asked = settle(titles.select(key, word.alias("_w")).where("_w <> ''"))
    words = settle(asked.select("_w").distinct())
    low = covers.select("pos", F.lower("cover").alias("_low"))

    def pieces(text: Column, n: int) -> Column:
        return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))

    all_pieces = F.flatten(F.array_compact(F.array(*[pieces(F.col("_low"), n) for n in (1, 2, 3)])))
    postings = settle(low.select("pos", F.explode(all_pieces).alias("piece")))
    first = postings.groupBy(F.col("piece").alias("_w")).agg(F.min("pos").alias("pos"))
    short = words.where(F.length("_w") <= 3).join(first, "_w")
    often = postings.where(F.length("piece") == 3).groupBy("piece").agg(F.count("*").alias("_n"))
    long = words.where(F.length("_w") > 3).select("_w", F.explode(pieces(F.col("_w"), 3)).alias("piece")).join(often, "piece", "left")
    # a word with a piece that no cover has is in none
    rarest = settle(long.groupBy("_w").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "piece")).alias("_r")).where("_r.n > 0").select("_w", "_r.piece", "_r.n"))
    postings = postings.join(rarest.select("piece").distinct(), "piece", "left_semi")
    early = postings.withColumn("_nth", F.row_number().over(W.partitionBy("piece").orderBy("pos"))).where(F.col("_nth") <= FIRST_COVERS).drop("_nth")

    def held(some: DataFrame, lists: DataFrame) -> DataFrame:
        return some.join(lists, "piece").join(low, "pos").where(F.contains("_low", F.col("_w"))).groupBy("_w").agg(F.min("pos").alias("pos"))

    soon = settle(held(rarest, early))
    later = held(rarest.where(F.col("n") > FIRST_COVERS).join(soon, "_w", "left_anti"), postings)
    found = short.unionByName(soon).unionByName(later).join(covers.select("pos", "cover"), "pos")
    return asked.join(found, "_w").select(key, "cover")


def lineage(jobs: DataFrame, label: Column | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """(start, depth, job_id, label, is_current and the columns kept): the chain from each completed job (job_id, parent_id, job_type, status) through
    its parents, the job itself, the current one, at depth 0. It ends before a job that is missing, not completed or already in the chain.

    Chains of any length double with each join: a table of jumps holds for each job the one 2 ** k parents up, and rows
    up to depth 2 ** k give those up to twice that. Only where jumps never end, on cycles, chains are held against themselves.
    """
    done = settle(jobs.where("status = 'completed'").select("job_id", "parent_id", (F.col("job_type") if label is None else label).alias("label"), *kept))
    ids = done.select("job_id").distinct()
    jump = settle(done.join(ids.withColumnRenamed("job_id", "parent_id"), "parent_id", "left_semi").select("job_id", F.col("parent_id").alias("up")).distinct())
    rows, reach, n = ids.select(F.col("job_id").alias("start"), F.lit(0).alias("depth"), "job_id"), 1, ids.count()
    while not jump.isEmpty():
        further = rows.join(jump, "job_id").select("start", (F.col("depth") + reach).alias("depth"), F.col("up").alias("job_id"))
        rows = settle(rows.unionByName(further).groupBy("start", "job_id").agg(F.min("depth").alias("depth")))
        if reach > n:  # longer than any chain without a repeat: all jumps left run round cycles, whose jobs are all met
            break
        ahead = jump.select(F.col("job_id").alias("up"), F.col("up").alias("_up"))
        jump, reach = settle(jump.join(ahead, "up").select("job_id", F.col("_up").alias("up"))), 2 * reach
    return rows.join(done.select("job_id", "label", *kept), "job_id").select("start", "depth", "job_id", "label", (F.col("depth") == 0).alias("is_current"), *kept)


def number_links(links: DataFrame, most: int = 100) -> DataFrame:
    """links (doc_id, pos, href, number) with final_number, numbered and reused.

    The first link with a number keeps it; others get the numbers after the largest of the document, in order. reused
    tells a repeated number with another URL. Only the first `most` links of a document stay.
    """
    first = W.partitionBy("doc_id", "number").orderBy("pos")
    own = W.partitionBy("doc_id")
    out = links.withColumns({"_claim": F.col("number").isNotNull() & (F.row_number().over(first) == 1), "_url": F.first("href").over(first), "_top": F.coalesce(F.max("number").over(own), F.lit(0))})
    out = out.withColumns({"_nth": F.sum((~F.col("_claim")).cast("int")).over(own.orderBy("pos")), "_i": F.row_number().over(own.orderBy("pos"))})
    return out.where(F.col("_i") <= most).select(
        *links.columns, F.when(F.col("_claim"), F.col("number")).otherwise(F.col("_top") + F.col("_nth")).cast("long").alias("final_number"), F.col("_claim").alias("numbered"),
        (F.col("number").isNotNull() & ~F.col("_claim") & (F.col("href") != F.col("_url"))).alias("reused"),
    )
