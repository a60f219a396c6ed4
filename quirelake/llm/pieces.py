"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

The model is a byte-fallback BPE without normalisation: blanks become `▁`, one `▁` is put in front. Its encoding is the
one sequence of pieces in which every two neighbours are stable (encoding both together gives them back), so it is
also the one path of weight 0 through the lattice of pieces, where an unstable pair weighs minus infinity. A boundary
between chunks has a state for each piece that ends at or reaches over it. A chunk yields the max-plus matrix from its
entry states to its exit states, here as the list of its finite cells; matrices of a document are combined in an
associative scan of joins, level by level, which fixes each chunk's states, and the chunks are then traced back independently.

No piece holds `▁` after another character, so a word start needs no state: between two of them a chunk is encoded
word by word, and words are remembered. Those words, and texts below CHUNK characters, are encoded by the sentencepiece
library itself; the scan adds what the library cannot do, a giant text over many tasks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import Uncut, WordMemory, settle, text_column

#: Characters of a chunk; longer documents are cut.
CHUNK = 32_768
#: Words that one worker remembers the ids of, at most, in each of two generations.
REMEMBERED = 100_000
_BLANK = "▁"
_START, _END = (-2, 0), (-3, 0)


class Pieces:
    """One model. Ids of known characters and pieces; a character without a piece is written as its bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        names = [self.model.id_to_piece(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(n)]
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not self.model.is_byte(i)}
        self.names = {i: p for p, i in self.ids.items()}
        self.rank = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        raw = {i: bytes([b]) for b, i in self.byte.items()} | {i: p.replace(_BLANK, " ").encode() for p, i in self.ids.items()}
        self.raw = [raw.get(i, b"") for i in range(n)]
        self.known = WordMemory(self._word, REMEMBERED)
        self.pairs: dict[tuple[str, str], bool] = {}

    # whole texts

    def _whole(self, text: str) -> bytes:
        return array("H", self.model.encode(text)).tobytes()

    def _word(self, word: str) -> bytes:
        if not word or word[-1] == _BLANK:  # a run of blanks is not cut
            raise Uncut
        return self._whole(word)

    def encode(self, text: str) -> bytes:
        """The ids of a text as 16-bit words in the machine's order."""
        if not text:
            return b""
        try:
            return b"".join(self.known.all(text.split(" ")))
        except Uncut:
            return self._whole(text)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids.tolist()])
        return out[1:].decode(errors="replace") if out[:1] == b" " else out.decode(errors="replace")

    # chunks

    def merged(self, text: str) -> list[str]:
        """The BPE pieces of a short string, best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [(-self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not scores:
                break
            i = min(scores)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stable(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a; a is empty at the start of a text."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def _is_piece(self, part: str) -> bool:
        return len(part) == 1 or part in self.ids

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(length, overhang) of the pieces of text that start before `at` and end there or later."""
        return [
            (i + k, k)
            for i in range(1, min(self.longest, at) + 1)
            for k in range(min(self.longest - i, len(text) - at) + 1)
            if self._is_piece(text[at - i : at + k])
        ]

    def last_pieces(self, text: str, low: int, high: int, before: str, like: dict[int, int] | None = None) -> dict[int, int]:
        """For each place up to high the length of the one piece that may end there, if `before` ends at low.

        like: such a result for another start; once both agree over a piece's length, the rest is taken from it.
        """
        out, agreed = {}, 0
        for p in range(low + 1, high + 1):
            for n in range(min(self.longest, p - low), 0, -1):
                q = p - n
                part = text[q:p]
                if not self._is_piece(part):
                    continue
                if q == low:
                    ok = self.stable(before, part)
                else:
                    ok = q in out and self.stable(text[q - out[q] : q], part)
                if ok:
                    out[p] = n
                    break
            if like is not None:
                agreed = agreed + 1 if out.get(p) == like.get(p) else 0
                if agreed > self.longest:
                    out |= {x: like[x] for x in range(p + 1, high + 1) if x in like}
                    break
        return out

    def word_starts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and last place in (low, high) where a `▁` follows another character."""
        first = next(self._starts(text, low + 1, high), None)
        if first is None:
            return None
        last = text.rfind(_BLANK, low + 1, high)
        while last > first and text[last - 1] == _BLANK:
            last = text.rfind(_BLANK, low + 1, last)
        return first, max(first, last)

    @staticmethod
    def _starts(text: str, low: int, high: int) -> Iterator[int]:
        at = text.find(_BLANK, low, high)
        while at >= 0:
            if text[at - 1] != _BLANK:
                yield at
            at = text.find(_BLANK, at + 1, high)

    def _exits(self, text: str, begin: int, end: int, before: str, last: bool, like: dict[int, int] | None = None):
        """({exit state: place where its piece starts}, the last pieces), for a piece `before` that ends at begin."""
        ends = self.last_pieces(text, begin, end, before, like)
        if last:
            return ({_END: end} if end in ends or begin == end else {}), ends
        out = {}
        for n, over in self.states(text, end):
            q = end + over - n
            prior = before if q == begin else text[q - ends[q] : q] if q in ends else None
            if q >= begin and prior is not None and self.stable(prior, text[q : q + n]):
                out[n, over] = q
        return out, ends

    def matrix(self, text: str, low: int, high: int, first: bool, last: bool) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """The finite cells (entry state, exit state) of the chunk [low, high) of text, which holds its surroundings too."""
        entries = [_START] if first else self.states(text, low)
        turn = self.word_starts(text, low, high)
        out, like = [], None
        exits = None
        for n, over in entries:
            begin, before = (low, "") if first else (low + over, text[low + over - n : low + over])
            if turn and begin <= turn[0]:
                ends = self.last_pieces(text, begin, turn[0], before, like)
                like = like or ends
                if turn[0] in ends or begin == turn[0]:
                    if exits is None:
                        exits = list(self._exits(text, turn[1], high, "", last)[0])
                    out += [((n, over), x) for x in exits]
            else:
                found, ends = self._exits(text, begin, high, before, last, like)
                like = like or ends
                out += [((n, over), x) for x in found]
        return out

    def _back(self, text: str, low: int, high: int, ends: dict[int, int]) -> list[str]:
        parts = []
        while high > low:
            parts.append(text[high - ends[high] : high])
            high -= ends[high]
        return parts[::-1]

    def _ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            out += [self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()]
        return out

    def trace(self, text: str, low: int, high: int, first: bool, entry: tuple[int, int], leave: tuple[int, int]) -> np.ndarray:
        """The ids of the pieces that start in the chunk, given its entry and exit states."""
        begin, before = (low, "") if first else (low + entry[1], text[low + entry[1] - entry[0] : low + entry[1]])
        turn, head = self.word_starts(text, low, high), np.zeros(0, np.uint16)
        if turn and begin <= turn[0]:
            ends = self.last_pieces(text, begin, turn[0], before)
            middle = text[turn[0] + 1 : turn[1]].replace(_BLANK, " ") if turn[1] > turn[0] else ""
            head = np.r_[np.array(self._ids(self._back(text, begin, turn[0], ends)), np.uint16), np.frombuffer(self.encode(middle), np.uint16)]
            begin, before = turn[1], ""
        exits, ends = self._exits(text, begin, high, before, leave == _END)
        q = exits[leave]
        tail = self._back(text, begin, q, ends) + ([text[q : q + leave[0]]] if leave != _END else [])
        return np.r_[head, np.array(self._ids(tail), np.uint16)].astype(np.uint16)


_models: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    """This worker's model, kept from task to task; name is a file of the public tokenizers or a path."""
    if name not in _models:
        import public_tokenizers

        _models[name] = Pieces(name if "/" in name else public_tokenizers.path(name))
    return _models[name]


def product(one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
    """The max-plus product of two matrices given by their finite cells (entry state, exit state, and what follows): cells of entry,
    exit and the state between. Every finite weight is 0, so that any state between is as good as another."""
    after: dict[tuple, list[tuple]] = {}
    for cell in other:
        after.setdefault(tuple(cell[:2]), []).append(tuple(cell[2:4]))
    cells = {(*cell[:2], *leave): tuple(cell[2:4]) for cell in one for leave in after.get(tuple(cell[2:4]), ())}
    return [[*c, *between] for c, between in cells.items()]


_CELLS = T.ArrayType(T.ArrayType(T.IntegerType()))


@F.arrow_udf(_CELLS)
def _products(one: pa.Array, other: pa.Array) -> pa.Array:
    kind = pa.list_(pa.list_(pa.int32()))
    return pa.array([a if b is None else product(a, b) for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True)], kind)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _between(cells: pa.Array, route: pa.Array) -> pa.Array:
    """The state in the middle of a route (entry, exit) through a product."""
    found = [next(c[4:6] for c in cell if c[:4] == r) for cell, r in zip(cells.to_pylist(), route.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.int32()))


def routes_through(matrices: DataFrame) -> DataFrame:
    """(uid, chunk, route): entry and exit state of each chunk of a table (uid, chunk, cells).

    An up-sweep multiplies neighbouring matrices level by level, a join a level, until one is left of each text; a
    down-sweep hands the states of each product to its two factors. A text's chunks are never gathered: after k joins
    a row stands for 2 ** k of them, with a few cells.
    """
    levels = [settle(matrices.select("uid", "chunk", "cells"))]
    while not levels[-1].where("chunk > 0").isEmpty():
        half = levels[-1].withColumn("pair", F.expr("chunk div 2").cast("int"))
        right = half.where("chunk % 2 = 1").select("uid", "pair", F.col("cells").alias("other"))
        both = half.where("chunk % 2 = 0").join(right, ["uid", "pair"], "left")
        up = both.select("uid", F.col("pair").alias("chunk"), _products("cells", "other").alias("cells"), F.col("other").isNull().alias("single"))
        levels.append(settle(up))
    route = F.slice(F.get("cells", F.lit(0)), 1, 4)
    found = levels[-1].select("uid", "chunk", route.alias("route"))
    for up in reversed(levels[1:]):
        known = up.join(found, ["uid", "chunk"])
        alone = known.where("single").select("uid", (2 * F.col("chunk")).alias("chunk"), "route")
        split = known.where("not single").withColumn("mid", _between("cells", "route"))
        parts = F.array(F.struct((2 * F.col("chunk")).alias("chunk"), F.concat(F.slice("route", 1, 2), "mid").alias("route")), F.struct((2 * F.col("chunk") + 1).alias("chunk"), F.concat("mid", F.slice("route", 3, 2)).alias("route")))
        found = settle(alone.unionByName(split.select("uid", F.inline(parts))))
    return found


def _chunks(rows: DataFrame, size: int, margin: int) -> DataFrame:
    """The chunks of texts with their surroundings, dealt over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = _BLANK + text.replace(" ", _BLANK)
                starts = range(0, len(whole), size)
                cut = [(max(0, s - margin), s, min(s + size, len(whole))) for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uid] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([len(cut)] * len(cut), pa.int32()),
                        pa.array([s - a for a, s, _ in cut], pa.int32()), pa.array([e - a for a, _, e in cut], pa.int32()),
                        pa.array([whole[a : e + margin] for a, _, e in cut], pa.string()),
                    ],
                    names=["uid", "chunk", "n_chunks", "low", "high", "part"],
                )

    return rows.mapInArrow(run, "uid long, chunk int, n_chunks int, low int, high int, part string").repartition("uid", "chunk")


def _giant_ids(rows: DataFrame, model: str, size: int) -> DataFrame:
    """(uid, ids) of rows (uid, text) by the scan over chunks."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cell = coder.matrix(r["part"], r["low"], r["high"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1)
                out.append([[*a, *b] for a, b in cell])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["uid", "chunk", "cells"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model)
        for batch in batches:
            ids = [coder.trace(r["part"], r["low"], r["high"], r["chunk"] == 0, tuple(r["route"][:2]), tuple(r["route"][2:])).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(ids, pa.binary())], names=["uid", "chunk", "ids"])

    parts = settle(_chunks(rows, size, 2 * 16))
    matrices = parts.mapInArrow(cells, "uid long, chunk int, cells array<array<int>>")
    traced = parts.join(routes_through(matrices), ["uid", "chunk"]).mapInArrow(trace, "uid long, chunk int, ids binary")
    return traced.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", size: int = CHUNK) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids give back), one row a row of docs.

    A null text is empty and has no ids. Repeated rows and null ids of documents stay; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    giant = F.length("text") >= size

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model)
        for batch in batches:
            if "text" in batch.schema.names:
                raw = [coder.encode(t) for t in batch.column("text").to_pylist()]
            else:
                raw = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
            ids = [np.frombuffer(x, np.uint16) for x in raw]
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=at[1:])
            flat = np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([coder.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    schema = "doc_id long, ids array<int>, decoded string"
    plain = rows.where(~giant).select("doc_id", "text").mapInArrow(finish, schema)
    large = rows.where(giant)
    if large.isEmpty():
        return plain
    large = settle(large)
    joined = large.select("uid", "doc_id").join(_giant_ids(large.select("uid", "text"), model, size), "uid")
    return plain.unionByName(joined.select("doc_id", "parts").mapInArrow(finish, schema))
