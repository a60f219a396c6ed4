"""N-gram Jaccard join with parity sketches.

A document is its set of word shingles. XOR-hashing the set into a sketch of K words (a shingle's hash is XORed into
one word, which the hash chooses) gives a linear parity sketch: a shingle that only one of two documents has changes at most one
word, so the number of differing words never exceeds the symmetric difference of the sets. Documents are compared per
band of set sizes; within a band the threshold bounds that difference by D, and with K = D + 1 + S words two linked
documents agree in S + 1 words or more. Words are the keys of the pigeonhole join; sets verify what they propose.

The keys are counted and joined in PASSES passes, each over the words of one residue, so that only that share of them
is shuffled at a time; only keys that several nodes share are ever written as rows.

Skew. Equal sets are one node before the join. A key that many nodes share (an empty word, a common passage) is left
out for all nodes with at most S such keys: a linked partner agrees in one more word at least. Nodes with more, as in
large groups of near copies, keep them. Within a key, members are first compared with one centre, and again only
across components that the links so far leave apart, so that work is linear in a group that hangs together.

A second, compact sketch of single bits (a shingle flips one of about 4 D bits) prunes the proposed pairs: its Hamming
distance never exceeds the symmetric difference either. Only pairs that pass it fetch their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import Stored, bit_filter, give_back, hashed_words, lists_of_longs, mix64, own_columns, passing, row_slices, settle, shingle_sets, text_column
from quirelake.llm.components import components

#: Nodes that share a key, above which the key counts as frequent.
FREQUENT = 64
#: Spare sketch words, as a share of the words that the pigeonhole needs.
SPARE = 0.08
#: Passes over the sketch words.
PASSES = 4
#: Rounds after the first; before the last, in which all pairs across components are looked at, one centre a key is.
ROUNDS = 3
#: Bytes of text that a worker makes into sets at once; a longer text stands alone.
SLICE = 1 << 20


class Bands:
    """Bands of set sizes for the threshold num / den. Band c holds pairs whose smaller size is in [low[c], low[c+1])."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        ratio = max(1.35, den / num)
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n elements can have a partner."""
        last = int(np.searchsorted(self.low, n, "right")) - 1
        return [c for c in range(max(0, last - 2), last + 1) if n * self.num <= (self.low[c + 1] - 1) * self.den]

    def words(self, c: int) -> tuple[int, int]:
        """(words of the sketch, spare words) of a band."""
        small = self.low[c + 1] - 1
        far = (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        spare = 1 + math.ceil(SPARE * (far + 1)) if far else 0
        return far + 1 + spare, spare


def sketch(hashes: np.ndarray, c: int, words: int) -> np.ndarray:
    """The keys of one set's parity sketch in a band."""
    own = mix64(hashes + np.uint64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    place = ((own >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    parity = np.zeros(words, np.uint64)
    np.bitwise_xor.at(parity, place.astype(np.int64), mix64(own))
    return mix64(parity + mix64(np.arange(words, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(40))))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE bytes of text: what is made of a part takes many times its size."""
    for batch in batches:
        for low, high in row_slices(batch.column("text"), SLICE):
            yield batch.slice(low, high - low)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    words, at = hashed_words(batch.column("text"), lower=True)
    return shingle_sets(words, at, k)


def bit_sketch(hashes: np.ndarray, c: int, far: int) -> np.ndarray:
    """The parity of the set in about 4 * far single bits, as words."""
    size = 64 * max(4, -(-far // 16))
    own = mix64(hashes ^ np.uint64((c + 7) * 0xD1B54A32D192ED03 % (1 << 64)))
    parity = np.bincount((((own >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def sketched(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row for each band of each text's set: doc_id, n (the set's size), k1 and k2 (128 bits that tell it from others),
    first (whether it is the text's first row), band, spare, bits (of the bit sketch), and keys_0, keys_1 .. (of the word
    sketch, a column for each pass). An empty set has one row without a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den, 1 << 34)
        for batch in _sliced(batches):
            rows = []
            for i, hashes in enumerate(_sets(batch, k)):
                whole = mix64(hashes)
                one = (i, len(hashes), np.bitwise_xor.reduce(whole), whole.sum(dtype=np.uint64))
                if not len(hashes):
                    rows.append((*one, True, None, 0, hashes, hashes))
                for c in bands.of(len(hashes)) if len(hashes) else ():
                    words, spare = bands.words(c)
                    rows.append((*one, rows[-1][0] != i if rows else True, c, spare, sketch(hashes, c, words), bit_sketch(hashes, c, words - 1 - spare)))
            i, n, k1, k2, first, band, spare, keys, bits = zip(*rows, strict=True) if rows else ((),) * 9
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (k1, k2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(i, pa.int64())), pa.array(n, pa.int64()), *longs, pa.array(first, pa.bool_()),
                    pa.array(band, pa.int32()), pa.array(spare, pa.int32()), lists_of_longs(list(bits)), *[lists_of_longs([x[p::PASSES] for x in keys]) for p in range(PASSES)],
                ],
                names=["doc_id", "n", "k1", "k2", "first", "band", "spare", "bits", *shares],
            )
            del batch, rows, i, n, k1, k2, first, band, spare, keys, bits, longs
        give_back()

    shares = [f"keys_{p}" for p in range(PASSES)]
    schema = "doc_id long, n long, k1 long, k2 long, first boolean, band int, spare int, bits array<long>" + "".join(f", {x} array<long>" for x in shares)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _shingles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = list(_sets(batch, k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists_of_longs(sets)], names=["doc_id", "n", "hashes"])
            del batch, sets
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, hashes array<long>")


def _entries(sketches: DataFrame, nodes: DataFrame) -> Stored:
    """(key, node, band) of the sketch words that propose partners, after frequent keys are left out where they can be.

    A linked node agrees with a partner in more words than the spare ones: nodes that share fewer keys go first.
    """
    met = []
    for p in range(PASSES):
        own = sketches.select("k1", "k2", "n", "doc_id", "band", "spare", f"keys_{p}").join(nodes, ["k1", "k2", "n", "doc_id"], "left_semi")
        own = own.select(F.explode(f"keys_{p}").alias("key"), F.col("doc_id").alias("node"), "band", "spare")
        shared = Stored(own.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
        met.append(Stored(own.join(shared.rows, "key")))
        shared.free()
    entries = reduce(DataFrame.unionByName, [x.rows for x in met])
    counts = entries.groupBy("node", "band", "spare").agg(F.count("*").alias("n_keys"), F.count_if(F.col("m") > FREQUENT).alias("n_often"))
    live = Stored(counts.where("n_keys > spare").select("node", "band", (F.col("n_often") > F.col("spare")).alias("crowded")))
    kept = Stored(entries.join(live.rows, ["node", "band"]).where((F.col("m") <= FREQUENT) | F.col("crowded")).select("key", "node", "band"))
    for x in (*met, live):
        x.free()
    return kept


def _near(n_a, bits_a, n_b, bits_b, num: int, den: int):
    """Whether sizes and bit sketches leave it possible that two sets are linked."""
    apart = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num) & (apart * (den + num) <= (n_a + n_b) * (den - num))


def _verified(near: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of near that are linked, by their sets."""
    near = Stored(near)
    ids = near.rows.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = bit_filter(ids, "doc_id")
    texts = passing(docs.select(F.col("doc_id").cast("long"), "text"), held, "doc_id").where("_passes").drop("_passes")
    sets = Stored(_shingles(texts.join(ids, "doc_id", "left_semi"), k))
    met = near.rows.join(sets.rows.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("x")), "a")
    met = met.join(sets.rows.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = settle(met.select("a", "b", "n_a", "n_b", common.alias("i")).where(F.col("i") * den >= (F.col("n_a") + F.col("n_b") - F.col("i")) * num).select("a", "b"))
    near.free(), sets.free()
    return links


def _labelled(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """entries with the component of each node, only of keys whose nodes are in several."""
    named = settle(entries.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"))
    mixed = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    return settle(named.join(mixed, "key"))


def _starred(entries: DataFrame, marks: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Near pairs (a, b): each node with the one that is the centre of most of its keys. A key's centre is one of its
    nodes, another one each turn; only nodes of other components count."""
    chance = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    centre = entries.groupBy("key").agg(F.min_by(F.struct("node", "part"), chance).alias("c"))
    met = entries.join(centre, "key").where(F.col("part") != F.col("c.part"))
    often = met.groupBy("node", "band", F.col("c.node").alias("centre")).agg(F.count("*").alias("m"))
    best = often.groupBy("node", "band").agg(F.max_by("centre", F.struct("m", "centre")).alias("centre"))
    pairs = best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), "band").distinct()
    left = marks.select(F.col("node").alias("a"), "band", F.col("n").alias("n_a"), F.col("bits").alias("x"))
    right = marks.select(F.col("node").alias("b"), "band", F.col("n").alias("n_b"), F.col("bits").alias("y"))
    met = pairs.join(left, ["a", "band"]).join(right, ["b", "band"])
    return met.where(_near(F.col("n_a"), F.col("x"), F.col("n_b"), F.col("y"), num, den)).select("a", "b").distinct()


def _across(entries: DataFrame, marks: DataFrame, num: int, den: int) -> tuple[DataFrame, int]:
    """All near pairs (a, b) of nodes of a key that are in different components, and how many pairs are looked at.

    The nodes outside a key's largest component meet all the others; only near ones come out of the join.
    """
    sizes = entries.groupBy("key", "part").agg(F.count("*").alias("m"))
    largest = settle(sizes.groupBy("key").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("m_main")))
    bound = largest.agg(F.sum((F.col("m") - F.col("m_main")) * F.col("m"))).first()[0] or 0
    entries = entries.join(marks, ["node", "band"])
    few = entries.join(largest.select("key", "main"), "key").where("part <> main")
    few = few.select("key", F.col("node").alias("o"), F.col("part").alias("p"), "main", F.col("n").alias("n_o"), F.col("bits").alias("x"))
    apart = (F.col("part") != F.col("p")) & ((F.col("part") == F.col("main")) | (F.col("node") < F.col("o")))
    met = entries.join(few, "key").where(apart & _near(F.col("n"), F.col("bits"), F.col("n_o"), F.col("x"), num, den))
    return met.select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b")).distinct(), bound


def similar_groups(docs: DataFrame, k: int, num: int, den: int = 100) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Texts link when den * intersection >= num * union of their sets of k-word shingles (A-Z lower-cased; fewer than k
    words: the whole sequence). A text without words, or null, has an empty set and no link. A row with a null doc_id
    has none either and a null component_id. Repeated rows are copies of one node; doc_id is taken to tell texts apart.
    Other columns are not read.
    """
    sketches = Stored(sketched(docs, k, num, den))
    rows = settle(sketches.rows.where("first").select("doc_id", "n", "k1", "k2"))
    usable = rows.where("n > 0 and doc_id is not null")
    kinds = settle(usable.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")))
    nodes = kinds.select("k1", "k2", "n", F.col("node").alias("doc_id"))
    stored = _entries(sketches.rows.where("band is not null"), nodes)
    entries = stored.rows
    live = entries.select("node", "band").distinct()
    marks = sketches.rows.select("k1", "k2", "n", "doc_id", "band", "bits").join(nodes, ["k1", "k2", "n", "doc_id"], "left_semi")
    marks = Stored(marks.select(F.col("doc_id").alias("node"), "band", "n", "bits").join(live, ["node", "band"], "left_semi"))
    sketches.free()

    total = entries.count()
    links = _verified(_starred(entries.withColumn("part", F.col("node")), marks.rows, 0, num, den), docs, k, num, den)
    for turn in range(1, ROUNDS + 1):
        left = _labelled(entries, components(links))
        pairs, bound = _across(left, marks.rows, num, den)
        last = turn == ROUNDS or bound <= 64 * total + 1_000_000
        links = links.unionByName(_verified(pairs if last else _starred(left, marks.rows, turn, num, den), docs, k, num, den))
        if last:
            break
    stored.free(), marks.free()
    parts = components(links)
    named = kinds.join(parts.withColumnRenamed("id", "node"), "node", "left")
    told = settle(named.select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id")))
    some = usable.select("doc_id", "n", "k1", "k2").join(told, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(rest)


def _spelled(docs: DataFrame) -> DataFrame | None:
    """(doc_id, _sha, _alias) of the texts whose doc_id another row has too, each with an id that no row has; None if there are none."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column(docs)).alias("h"))
    shared = settle(ids.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"))
    if shared.isEmpty():
        return None
    texts = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_column(docs), 256).alias("_sha")).join(shared, "doc_id", "left_semi").distinct())
    for seed in count():
        named = texts.withColumn("_alias", F.xxhash64("doc_id", "_sha", F.lit(seed)))
        repeated = named.groupBy("_alias").count().where("count > 1")
        if repeated.isEmpty() and named.join(ids, named["_alias"] == ids["doc_id"], "left_semi").isEmpty():
            return named


def drop_similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which one a group stays: that with the smallest doc_id; columns as they came.

    Rows are told apart by their text where they share a doc_id; of rows with the same doc_id and text one stays, unless
    the text has no words.
    """
    spelled = _spelled(docs)
    if spelled is None:
        groups = similar_groups(docs, k, num, den)
        gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    rows = docs.select(F.struct(*own_columns(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_column(docs).alias("text"))
    own = spelled.select(F.col("doc_id").alias("_own"), F.col("_sha"), "_alias")
    rows = rows.join(own, (F.col("_id") == F.col("_own")) & (F.sha2("text", 256) == F.col("_sha")), "left")
    again = F.col("_alias").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = rows.select("_row", "text", F.coalesce("_alias", "_id").alias("doc_id"), again.alias("_again"))
    groups = settle(similar_groups(rows, k, num, den).where("doc_id is not null").select("doc_id", "component_id").distinct())
    named = groups.join(spelled.select(F.col("_alias").alias("doc_id"), F.col("doc_id").alias("_first")), "doc_id", "left")
    named = named.withColumn("_first", F.coalesce("_first", "doc_id"))
    best = named.groupBy("component_id").agg(F.min(F.struct("_first", "doc_id"))["doc_id"].alias("_stays"))
    gone = groups.join(best, "component_id").where("doc_id <> _stays").select(F.col("doc_id").alias("_gone"))
    left = rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti")
    return left.where("not _again").unionByName(left.where("_again").dropDuplicates(["doc_id"])).select("_row.*")
