"""Packing by lexical retrieval: similar documents share windows of a fixed number of tokens, without padding.

Token ids are cut freely. The documents are dealt into shards of a bounded number of tokens by a lexical signature, so
that documents with common passages meet. Each shard holds a BM25 inverted index over all token bigrams; a seed document asks it for
its unused neighbours by all of its bigrams, which fill the seed's window in order of their score. Document frequencies are
those of the shard, and a seed finds no neighbour in another one. What is left at the end of a shard goes into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import each_text, give_back, mix64, settle

WINDOW = 1024
#: Tokens of a shard at most, with ROW for each document besides its own: bounds the memory of one task. A single
#: document may be larger.
SHARD, ROW = 2_000_000, 32
#: Signatures are counted in so many steps for each doubling, 63 times as many in all.
STEPS = 1024
#: Rows whose texts and ids a worker holds at once while it encodes.
ROWS = 512
#: Neighbours that are put in order at first; the rest only where these leave room.
FIRST = 16
K1, B = 1.2, 0.75
#: The part of the tokenizer's pattern that looks ahead: it leaves the last of several blanks to the word that follows.
_AHEAD = r"|\s+(?!\S)"
#: Two blanks of the pattern's kind (Unicode's White_Space) side by side.
_WIDE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_NONE: set[str] = set()


class Encoder:
    """Ids of a byte-level BPE tokenizer."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

        def made(pattern: str) -> tiktoken.Encoding:
            # a special token is named so that it is searched for as a whole; without one each place is looked at. None is allowed.
            return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 1 << 16})

        self.plain = made(public_tokenizers.PATTERN.replace(_AHEAD, ""))
        self.make_ahead, self.ahead = lambda: made(public_tokenizers.PATTERN), None
        self.path, self.full = public_tokenizers.path(f"{name}.json"), None

    def ids(self, text: str, wide: bool = True) -> bytes:
        """The ids as 16-bit words in the machine's order. A text that holds a special token's name takes the full
        tokenizer, any other the plain one, which gives the same ids. wide: whether two blanks may stand side by side;
        where none do, the pattern needs no look ahead and gives the same words in less time."""
        if "<|" in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return array("H", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        if wide and self.ahead is None:
            self.ahead = self.make_ahead()
        return (self.ahead if wide else self.plain).encode_to_numpy(text, allowed_special=_NONE, disallowed_special=()).astype(np.uint16).tobytes()

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null as empty."""
        wide = pc.fill_null(pc.match_substring_regex(texts, _WIDE), False)
        return map(self.ids, each_text(texts), wide.to_pylist())


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def forget_encoders() -> None:
    """Free this worker's encoders; they are made anew when asked for."""
    _encoders.clear()
    give_back()


def _terms(ids: np.ndarray) -> np.ndarray:
    """The token bigrams."""
    return ids[:-1].astype(np.uint32) << np.uint32(16) | ids[1:]


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, n_ids, signature): the 16-bit ids with the closing id 0, and the smallest term hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            ids = [x + b"\0\0" for x in coder.all_ids(batch.column("text"))]
            least = [int(mix64(t.astype(np.uint64)).min() >> np.uint64(1)) if len(t := _terms(np.frombuffer(x, np.uint16))) else 0 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(least, pa.int64())],
                names=["doc_id", "ids", "n_ids", "signature"],
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_ids long, signature long")


class Index:
    """BM25 over the documents of one shard. Postings of a term stand together, by document."""

    def __init__(self, ids: list[np.ndarray]):
        size = np.array([max(len(x) - 1, 0) for x in ids], np.int64)
        flat, low = np.zeros(int(size.sum()), np.uint64), 0
        for k, x in enumerate(ids):  # term and document in one word, filled and sorted in place
            part = flat[low : low + size[k]]
            part[:] = _terms(x)
            part <<= np.uint64(32)
            part |= np.uint64(k)
            low += int(size[k])
        flat.sort()
        # arrays of the shard's size are few at a time, places in them as short as they may be
        place = np.int32 if len(flat) < 1 << 31 else np.int64
        term = (flat >> np.uint64(32)).astype(np.uint32)
        again = term[1:] == term[:-1]
        del term
        shared = np.r_[False, again] | np.r_[again, False] if len(flat) else np.zeros(0, bool)
        flat = flat[shared]  # a term that occurs once finds none
        del again, shared
        at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]).astype(place) if len(flat) else np.zeros(0, place)
        tf = np.diff(np.append(at, place(len(flat)))).astype(np.int32, copy=False)
        flat = flat[at]
        del at
        term, doc = (flat >> np.uint64(32)).astype(np.uint32), flat.astype(np.uint32).view(np.int32)
        del flat
        head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(head, len(term)))
        del term, head
        shared = np.repeat(df > 1, df)  # nor does one of a single document
        self.doc, tf, df = doc[shared], tf[shared], df[df > 1]
        del doc, shared
        norm = K1 * (1 - B + B * size / max(size.mean(), 1.0)) if len(size) else size
        idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
        self.score = np.repeat(idf, df)
        self.score *= tf
        self.score *= K1 + 1
        below = norm.take(self.doc)
        below += tf
        self.score /= below
        del below, tf
        self.term = np.repeat(np.arange(len(df), dtype=np.int32), df)
        self.end = np.cumsum(df)
        self.begin = self.end - df
        # a stable sort of 16-bit words is a radix sort
        mine = np.argsort(self.doc.astype(np.uint16) if len(ids) <= 1 << 16 else self.doc, kind="stable")
        self.own, self.from_ = self.term[mine], np.append(0, np.cumsum(np.bincount(self.doc, minlength=len(ids))))
        self.passed = 0

    def _drop(self, unused: np.ndarray) -> None:
        """Leave used documents out of the postings."""
        stay = unused.take(self.doc)
        at = np.zeros(len(stay) + 1, np.int32 if len(stay) < 1 << 31 else np.int64)
        np.cumsum(stay, out=at[1:])
        self.begin, self.end, self.passed = at[self.begin].astype(np.int64), at[self.end].astype(np.int64), 0
        at = np.flatnonzero(stay)
        self.doc, self.score, self.term = self.doc.take(at), self.score.take(at), self.term.take(at)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed, by their scores over all of its terms, best first."""
        terms = self.own[self.from_[seed] : self.from_[seed + 1]]
        begin, length = self.begin[terms], self.end[terms] - self.begin[terms]
        n = int(length.sum())
        if not n:
            return
        if 4 * n < len(self.doc):
            at = np.repeat(begin - np.cumsum(length) + length, length)
            at += np.arange(n)
            doc, score = self.doc.take(at), self.score.take(at)
        else:  # the postings of most terms: all are read in their order
            asked = np.zeros(len(self.begin), bool)
            asked[terms] = True
            at = np.flatnonzero(asked.take(self.term))
            doc, score = self.doc.take(at), self.score.take(at)
        if 8 * n < len(unused):  # few documents of the shard are met: only these are summed
            order = np.argsort(doc, kind="stable")
            doc, score = doc[order], score[order]
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            found, total = doc[heads].astype(np.int64), np.add.reduceat(score, heads)
        else:
            total = np.bincount(doc, score, len(unused))
            found = np.flatnonzero(total > 0)
            total = total[found]
        self.passed += n
        if self.passed > 8 * len(self.doc):
            self._drop(unused)
        free = unused[found]
        found, total = found[free], total[free]
        first = np.ones(len(found), bool)
        if len(found) > FIRST:
            first = total >= np.partition(total, -FIRST)[-FIRST]
        for group in (first, ~first):
            yield from found[group][np.lexsort((found[group], -total[group]))].tolist()


def order_of(ids: list[np.ndarray], window: int = WINDOW) -> list[int]:
    """The order in which a shard's documents are laid one after the other, each exactly once.

    A seed is the first unused document; its neighbours fill what room it leaves in the window it ends in, and the last
    of them may reach into the next one.
    """
    index, unused, out, room = Index(ids), np.ones(len(ids), bool), [], 0
    for seed in range(len(ids)):
        if not unused[seed]:
            continue
        unused[seed] = False
        out.append(seed)
        room = (room - len(ids[seed])) % window
        for n in index.neighbours(seed, unused) if room else ():
            unused[n] = False
            out.append(n)
            full, room = len(ids[n]) >= room, (room - len(ids[n])) % window
            if full:
                break
    return out


def _pieces(docs: list[tuple], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the shard's pieces; sequences count from 0."""
    total = sum(len(d[1]) for d in docs)
    ends = list(range(window, total + 1, window))
    rest = total - (ends[-1] if ends else 0)
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    at, sequence, begin = 0, 0, 0
    for k, d in enumerate(docs):
        start = 0
        while start < len(d[1]):
            take = min(len(d[1]) - start, ends[sequence] - at)
            yield k, start, take, sequence, at - begin
            start, at = start + take, at + take
            if at == ends[sequence]:
                sequence, begin = sequence + 1, at


def dealt_out(ready: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """ready (n_ids, signature and more) with shard, and the number of shards.

    Neighbouring signatures go together while their documents fit: the tokens of each step of signatures are counted,
    63 * STEPS rows for the driver at most, and steps are put into shards in their order. A step that is too large alone,
    such as that of one common passage or of all texts without terms, is dealt among as many shards as it fills.
    """
    slot = F.floor(F.log2(F.col("signature") + F.lit(1.0)) * STEPS).cast("int")
    weight = F.col("n_ids") + ROW
    cells = ready.groupBy(slot.alias("slot")).agg(F.sum(weight).alias("w")).orderBy("slot").collect()
    places, shards, filled = [], 0, shard
    for r in cells:
        salts = max(1, math.ceil(r["w"] / shard))
        if salts > 1 or filled + r["w"] > shard:
            places.append((r["slot"], shards, salts))
            shards, filled = shards + salts, r["w"] if salts == 1 else shard
        else:
            places.append((r["slot"], shards - 1, 1))
            filled += r["w"]
    # an Arrow table is read by the engine; a list of rows would start two Python workers and their parent on each executor
    columns = [pa.array(c, pa.int32()) for c in (zip(*places, strict=True) if places else ((), (), ()))]
    table = ready.sparkSession.createDataFrame(pa.table(columns, names=["slot", "first", "salts"]))
    # the rows are those of a checkpoint, so that their numbers stay the same
    met = ready.withColumns({"slot": slot, "row": F.monotonically_increasing_id()}).join(F.broadcast(table), "slot")
    return met.withColumn("shard", (F.col("first") + F.pmod("row", F.col("salts"))).cast("int")).drop("slot", "row", "first", "salts"), shards


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    window must be a power of two. A null text is empty and gives its closing id alone; repeated rows and null ids
    are packed like any other; other columns are not read. An empty table gives no piece.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    met, shards = dealt_out(settle(tokenised(docs, tokenizer)), shard)
    dealt = met.repartitionById(max(shards, 1), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list] = {}
        forget_encoders()  # of no more use once all is tokenised
        for batch in batches:
            ids = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
            for number, *row in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), ids, batch.column("signature").to_pylist(), strict=True):
                mine.setdefault(number, []).append(row)
        for number in sorted(mine):
            rows = mine.pop(number)
            rows.sort(key=lambda r: (r[2], r[0] is None, r[0] or 0, r[1].tobytes()))
            rows = [rows[i] for i in order_of([r[1] for r in rows], window)]
            out = []
            for k, start, take, sequence, offset in _pieces(rows, window):
                doc_id, ids, _ = rows[k]
                crc = zlib.crc32(ids[start : start + take].astype("<u4").tobytes())
                out.append((doc_id, start, take, crc, len(ids), (number << 32) + sequence, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            del rows, out, columns
            give_back()

    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
