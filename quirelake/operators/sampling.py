"""Sampling, interleaving and budgets over queues of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quirelake.operators.durable import settle


def balanced_sample(rows: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """target rows of each group, evenly spaced; all of a group that has no more."""
    own = W.partitionBy(group)
    numbered = rows.withColumns({"_i": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count("*").over(own)})
    k = F.expr(f"sequence(0, {target - 1})")
    picks = F.transform(k, lambda j: F.least(F.col("_n") - 1, F.floor((j * 2 + 1) * F.col("_n") / (2 * target)).cast("long")))
    return numbered.where((F.col("_n") <= target) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_n")


def overviews(rows: DataFrame, longest: int = 1600) -> DataFrame:
    """(doc_id, overview): rows 0, 1, n/3, n/2, 2n/3 and n-1 of each document's phrases, joined and cut."""
    own = W.partitionBy("doc_id")
    numbered = rows.withColumns({"_i": (F.row_number().over(own.orderBy("para_index")) - 1).cast("long"), "_n": F.count("*").over(own)})
    picks = F.expr("array(0L, 1L, _n div 3, _n div 2, 2 * _n div 3, _n - 1)")
    chosen = numbered.where(F.array_contains(picks, F.col("_i")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_i", "phrase"))), lambda s: s["phrase"])  # six rows at most
    return chosen.groupBy("doc_id").agg(F.left(F.array_join(parts, " "), F.lit(longest)).alias("overview"))


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with turn: first come all groups' first rows, by group, then all second ones."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(order)))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 1 in a total order, without one task that holds them all: rows are dealt by ranges
    of the order, counted, and numbered within their range."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))  # ranges are drawn once
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_count"))  # a row a range
    before = counts.select("_part", (F.sum("_count").over(W.orderBy("_part")) - F.col("_count")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def numbered_within(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place from 1 in each group. A group may span many tasks: rows are dealt by ranges of group and
    order and numbered within their range, and a range that goes on with a group of the one before adds what stands there."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(rows.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_count"))
    before = counts.withColumn("_before", F.sum("_count").over(W.partitionBy(*groups).orderBy("_part")) - F.col("_count"))
    # ranges follow each other, so that each goes on with one group at most
    going_on = before.where("_before > 0").select("_part", F.struct(*groups).alias("_group"), "_before")
    own = F.row_number().over(W.partitionBy("_part", *groups).orderBy(*order))
    met = dealt.withColumn("_own", own).join(F.broadcast(going_on), "_part", "left")
    more = F.when(F.struct(*groups).eqNullSafe(F.col("_group")), F.col("_before")).otherwise(0)
    return met.withColumn(name, F.col("_own") + more).drop("_part", "_own", "_group", "_before")


class _Free:
    """Places that are still free: each leads to the next free one on either side, over paths that are cut short when walked."""

    def __init__(self, n: int):
        self.n = n
        self.up, self.down = np.arange(n + 1, dtype=np.int64), np.arange(n + 1, dtype=np.int64)  # down is moved by one: 0 is before all

    @staticmethod
    def _end(way: np.ndarray, at: int) -> int:
        end = at
        while way[end] != end:
            end = way[end]
        while way[at] != end:
            way[at], at = end, way[at]
        return int(end)

    def take(self, place: int) -> None:
        if self.up[place] == place:
            self.up[place], self.down[place + 1] = place + 1, place

    def nearest(self, place: int) -> int | None:
        """The nearest free place, of two equally near ones the earlier."""
        low, high = self._end(self.down, place + 1) - 1, self._end(self.up, place)
        if low < 0 and high >= self.n:
            return None
        return low if high >= self.n or low >= 0 and place - low <= high - place else high


def _half(queries: np.ndarray) -> np.ndarray:
    """The places that half_coverage takes of plans whose queries have these numbers."""
    n = len(queries)
    half, order = (n + 1) // 2, np.argsort(queries, kind="stable")
    free, fresh, ordered = _Free(n), _Free(n), queries[order]
    taken = []
    for k in range(half):
        slot = min(n - 1, (2 * k + 1) * n // (2 * half))
        place = fresh.nearest(slot)
        if place is None:
            place = free.nearest(slot)
        else:  # its query is used from now on; each query leaves `fresh` once
            for other in order[np.searchsorted(ordered, queries[place], "left") : np.searchsorted(ordered, queries[place], "right")]:
                fresh.take(int(other))
        free.take(place)
        taken.append(place)
    return np.array(taken, np.int64)


def half_coverage(plans: DataFrame) -> DataFrame:
    """About half of each chapter's plans, spread and preferring unused queries: for each of ceil(n/2) evenly spaced
    slots the free plan with an unused query first, then nearest to the slot, then first.

    The choice is sequential in a chapter. Only para_index, which tells the plans of a chapter apart, and a 64-bit hash of the query are
    folded, from batches sorted by chapter; about 60 bytes a plan are held. The rows themselves are then picked by a join.
    """
    kind = dict(plans.dtypes)["chapter"]
    narrow = plans.select("chapter", F.col("para_index").cast("long").alias("at"), F.xxhash64("query").alias("q"))
    dealt = narrow.repartition("chapter").sortWithinPartitions("chapter", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current: pa.Array | None = None

        def out() -> pa.RecordBatch:
            at, q = (np.concatenate(x) for x in zip(*held, strict=True))
            chosen = at[_half(q)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([current] * len(chosen)), pa.array(chosen)], names=["chapter", "at"])

        for batch in batches:
            chapters, at, q = batch.columns
            codes = chapters.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            bounds = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if high > low:
                    mine = chapters.slice(low, 1)
                    if held and mine != current:
                        yield out()
                        held = []
                    current = mine
                    held.append((at[low:high].to_numpy(), q[low:high].to_numpy()))
        if held:
            yield out()

    chosen = dealt.mapInArrow(run, f"chapter {kind}, at long").withColumnsRenamed({"chapter": "_c", "at": "_at"})
    return plans.join(chosen, F.col("chapter").eqNullSafe(F.col("_c")) & (F.col("para_index") == F.col("_at")), "left_semi")


def batch_budget(queue: DataFrame, review: str, order: str, cursor: int = 0, per_batch: int = 16, overall: int = 80, lookups: int = 32, found_before: int = 0) -> DataFrame:
    """The rows of each review's queue that one batch works through, from the cursor on.

    A row is taken while fewer than per_batch results of this batch and overall results in all are found, and fewer
    than lookups rows were taken; failed lookups (found is false) advance too.
    """
    own = W.partitionBy(review).orderBy(order)
    before = own.rowsBetween(W.unboundedPreceding, -1)
    rows = queue.withColumn("_i", F.row_number().over(own) - 1).where(F.col("_i") >= cursor)
    hits = F.coalesce(F.sum(F.col("found").cast("int")).over(before), F.lit(0))
    taken = rows.withColumns({"_hits": hits, "_tried": F.col("_i") - cursor})
    return taken.where((F.col("_hits") < per_batch) & (F.col("_hits") + found_before < overall) & (F.col("_tried") < lookups)).drop("_i", "_hits", "_tried")


def _extension(name: Column) -> Column:
    """The suffix of a path's last part: from its last dot on, if something stands on both sides; else empty."""
    return F.regexp_extract(name, r"(?s)^(?:.*/)?[^/]+(\.[^./]+)$", 1)


def _without(text: Column, end: Column) -> Column:
    return F.left(text, F.length(text) - F.length(end))


def _name_families(names: DataFrame) -> DataFrame:
    """(b, l, family) of the names (b, l, n) that a suffix given to another one may reach, and of those that may reach
    them: connected components of such links, named by their smallest name.

    A name P that comes d times without being kept gets numbers 2, 3 … but those taken, so that it reaches P_k only if
    fewer than d numbers below k are free. Names are told apart by few links, which are followed until no family's name changes.
    """
    own = _extension(F.col("l"))
    tail = r"_([2-9]|[1-9][0-9]{1,8})$"
    stem = _without(F.col("l"), own)
    number = lambda t: F.regexp_extract(t, tail, 1)
    cut = lambda t: _without(t, F.concat(F.lit("_"), number(t)))
    inner = F.when(number(stem) != "", F.struct(F.concat(cut(stem), own).alias("p"), number(stem).cast("long").alias("k"), own.alias("e")))
    outer = F.when((own != "") & (number(F.col("l")) != ""), F.struct(cut(F.col("l")).alias("p"), number(F.col("l")).cast("long").alias("k"), F.lit("").alias("e")))
    made = names.select("b", "l", F.explode(F.array_compact(F.array(inner, outer))).alias("m")).select("b", "l", "m.*").where(_extension(F.col("p")) == F.col("e"))
    made = settle(made.join(names.select("b", F.col("l").alias("p"), F.col("n").alias("d")), ["b", "p"]))
    below = F.row_number().over(W.partitionBy("b", "p").orderBy("k")) - 1
    may_be_taken = made.select("b", F.col("l").alias("p"), F.lit(1).alias("t")).distinct()
    spare = made.withColumn("c", below).join(may_be_taken, ["b", "p"], "left").withColumn("d", F.col("d") - 1 + F.coalesce("t", F.lit(0)))
    links = spare.where(F.col("k") - 2 - F.col("c") < F.col("d")).select("b", "l", "p")
    # after a last dot a number makes a suffix, so that such names have two ways to be made and meet in names that no file has
    odd = names.where(F.col("l").endswith(".") | own.rlike(r"^\._([2-9]|[1-9][0-9]+)$"))
    links = links.unionByName(odd.select("b", "l", F.concat(F.lit("\0"), F.regexp_replace("l", "_([1-9][0-9]+|[2-9])", "")).alias("p")))
    both = settle(links.unionByName(links.select("b", F.col("p").alias("l"), F.col("l").alias("p"))).distinct())
    family = settle(both.groupBy("b", "l").agg(F.least(F.min("p"), F.first("l")).alias("family")))
    while True:
        near = both.join(family.select("b", F.col("l").alias("p"), F.col("family").alias("f")), ["b", "p"]).groupBy("b", "l").agg(F.min("f").alias("f"))
        new = settle(family.join(near, ["b", "l"]).select("b", "l", F.least("family", "f").alias("family"), (F.col("f") < F.col("family")).alias("changed")))
        if new.where("changed").isEmpty():
            return family
        family = new.drop("changed")


def unique_names(files: DataFrame, batch: str, order: str, name: str = "filename") -> DataFrame:
    """files with unique_name: names that are taken in any case get `_2`, `_3`… before the suffix, skipping names that
    are taken as well, in the order given. A null name stays null.

    Names that no suffix can bring together are independent: a name met once is kept, the copies of one that no other
    can reach are numbered, over as many tasks as they fill. Only families of names that can reach each other are folded
    in order, from sorted batches, each for itself; what a fold holds is the names it has given in that family.
    """
    low = F.lower(F.col(name))
    rows = files.withColumns({"_b": F.coalesce(F.concat(F.lit("="), F.col(batch).cast("string")), F.lit("")), "_l": low})
    names = settle(rows.where("_l is not null").groupBy(F.col("_b").alias("b"), F.col("_l").alias("l")).agg(F.count("*").alias("n")))
    families = _name_families(names)
    known = names.where("n > 1").join(families, ["b", "l"], "full").select(F.col("b").alias("_b"), F.col("l").alias("_l"), "family")
    met = settle(rows.join(known.withColumn("_again", F.lit(True)), ["_b", "_l"], "left").select(*[F.col(f"`{c}`") for c in files.columns], "_b", "_l", "family", "_again"))
    columns = [F.col(f"`{c}`") for c in files.columns]
    suffix = _extension(F.col(name))
    alone = met.where("_again is null").select(*columns, F.col(name).alias("unique_name"))
    copies = numbered_within(met.where("_again and family is null"), ["_b", "_l"], [order], "_nth")
    later = F.concat(_without(F.col(name), suffix), F.lit("_"), F.col("_nth").cast("string"), suffix)
    copies = copies.select(*columns, F.when(F.col("_nth") == 1, F.col(name)).otherwise(later).alias("unique_name"))
    mixed = met.where("family is not null").withColumns({"_e": suffix, "_s": _without(F.col(name), suffix), "_le": _extension(F.col("_l"))}).withColumn("_ls", _without(F.col("_l"), F.col("_le")))
    dealt = mixed.repartition("_b", "family").sortWithinPartitions("_b", "family", order)
    at, given = {c: i for i, c in enumerate(dealt.columns)}, files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, taken, tried = None, set(), {}  # tried: the last number known to be taken, for each name that came again
        for part in batches:
            out = []
            for b, family, full, s, e, lower, ls, le in zip(*[part.column(at[c]).to_pylist() for c in ("_b", "family", name, "_s", "_e", "_l", "_ls", "_le")], strict=True):
                if (b, family) != here:
                    here, taken, tried = (b, family), set(), {}
                if lower in taken:
                    k = tried.get(lower, 1) + 1
                    while f"{ls}_{k}{le}" in taken:
                        k += 1
                    tried[lower] = k
                    full, lower = f"{s}_{k}{e}", f"{ls}_{k}{le}"
                taken.add(lower)
                out.append(full)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(given)], pa.array(out, pa.string())], names=[*given, "unique_name"])

    schema = T.StructType([*files.schema.fields, T.StructField("unique_name", T.StringType())])
    return alone.unionByName(copies).unionByName(dealt.mapInArrow(run, schema))


def greedy_unique(plans: DataFrame, ranked: DataFrame, review: str, plan: str, queue: str) -> DataFrame:
    """(review, plan, identifier): in queue order each plan takes its best candidate that no earlier plan of the review
    took. ranked has (review, plan, identifier, rank).

    Rounds of joins: each plan proposes its best candidate left, the earliest plan that proposes a candidate holds it,
    and all later plans lose that candidate for good, for the holder can only be followed by an earlier one. Once a
    round takes nothing from any plan, every proposal is the choice. A review spreads over all tasks. There are as many
    rounds as the longest chain of plans that one after the other lose their candidate.
    """
    turn = F.struct(F.col(queue).alias("q"), F.col(plan).alias("p"))
    rows = plans.select(review, plan, turn.alias("_turn")).join(ranked.select(review, plan, "identifier", "rank"), [review, plan]).where("identifier is not null")
    rows, n = settle(rows), -1
    while True:
        best = rows.groupBy(review, plan, "_turn").agg(F.min(F.struct("rank", "identifier")).alias("_best"))
        best = best.select(review, plan, "_turn", F.col("_best.identifier").alias("identifier"))
        if (left := rows.count()) == n:
            return best.drop("_turn")
        n = left
        held = best.groupBy(review, "identifier").agg(F.min("_turn").alias("_first"))
        rows = settle(rows.join(held, [review, "identifier"], "left").where("_first is null or _turn <= _first").drop("_first"))


def running_caps(members: DataFrame, archive: str = "archive", most: int = 160, each: int = 25_000_000, whole: int = 200_000_000) -> DataFrame:
    """Members of an archive within its caps: at most `each` bytes, the first of equal paths in any case, the first
    `most` of these, while their sizes add up to at most `whole`."""
    small = members.where(F.col("bytes") <= each)
    first = small.withColumn("_same", F.row_number().over(W.partitionBy(archive, F.lower("path")).orderBy("pos"))).where("_same = 1")
    own = W.partitionBy(archive).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = first.withColumns({"_n": F.count("*").over(own), "_sum": F.sum("bytes").over(own)})
    return rows.where((F.col("_n") <= most) & (F.col("_sum") <= whole)).drop("_same", "_n", "_sum")
