"""Substring dedup by compaction of the de Bruijn graph of the texts' words.

An edge is a window of WINDOW consecutive words. Each edge has an anchor, the smallest hash of the ANCHOR-word pieces
in it, so equal edges have equal anchors. Consecutive edges of a text with one anchor make a path piece without a
branch. Anchors met once cannot hold a repeated edge and go first. Of the others, pieces of equal anchor and content
are one compacted path with many source coordinates; all but the earliest source are repeats as a whole. Only the
earliest sources of anchors with several contents, where the graph branches, are opened into single edges. Coordinates
(document, word) then give the spans to remove.

Words stand as 64-bit hashes. A piece is told from others by the 128 bits of anchor and content, an edge by its own 64
bits and the 64 of its anchor, so of n different windows of words two are taken for equal with odds of about n * n in
2 ** 65 within one anchor only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import bit_filter, hashed_words, mix64, passing, settle, shingle_hashes

WINDOW = 20
ANCHOR = 5

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Paths(NamedTuple):
    """Path pieces of a batch: text number, first edge within the text, number of edges, anchor, content; and, for all
    pieces together, the hash of each edge with `first`, the place of each piece's first edge in it."""

    text: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    edges: np.ndarray
    first: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def edge_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k words, by differences of running sums."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, len(words)), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * _powers(_BACK, n))


def paths(words: np.ndarray, at: np.ndarray, k: int = WINDOW, m: int = ANCHOR) -> Paths:
    """The path pieces of a batch of texts, given their words' hashes and offsets."""
    edges = edge_hashes(words, k)
    n = len(edges)
    if not n:
        none = np.zeros(0, np.int64)
        return Paths(none, none, none, none.view(np.uint64), none.view(np.uint64), edges, none)
    low = shingle_hashes(words, m)
    where = np.arange(len(low))
    span, done = k - m + 1, 1
    while done < span:  # the leftmost smallest of `done` pieces, then of twice as many
        step = min(done, span - done)
        later = low[step:] < low[:-step]
        low, where = np.where(later, low[step:], low[:-step]), np.where(later, where[step:], where[:-step])
        done += step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    whole = np.arange(n) + k <= at[text + 1]  # edges that lie in one text
    place = np.flatnonzero(whole)
    if not len(place):
        none = np.zeros(0, np.int64)
        return Paths(none, none, none, none.view(np.uint64), none.view(np.uint64), edges, none)
    new = np.r_[True, (np.diff(place) != 1) | (where[place[1:]] != where[place[:-1]]) | (text[place[1:]] != text[place[:-1]])]
    head = np.flatnonzero(new)
    first = place[head]
    size = np.diff(np.append(head, len(place)))
    offset = (where[place] - place).astype(np.uint64)
    content = mix64(np.add.reduceat(mix64(edges[place] + offset * np.uint64(_BASE)), head) + size.astype(np.uint64))
    return Paths(text[first], first - at[text[first]], size, low[first], content, edges, first)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with doc_id as a long or, where rows share one, a struct of it and the text's hash.

    Rows with the same doc_id and text stay alike: they are one document, met twice.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ids = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    shared = ids.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("m")).where("lo <> hi or m > 1")
    if shared.isEmpty():
        return docs
    return docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("doc_id"), "text")


def _pieces(docs: DataFrame, k: int) -> DataFrame:
    """(anchor, content, doc_id, begin, n) of all path pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = paths(*hashed_words(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays(
                [_signed(p.anchor), _signed(p.content), batch.column("doc_id").take(pa.array(p.text, pa.int64())), pa.array(p.begin, pa.int32()), pa.array(p.n, pa.int32())],
                names=["anchor", "content", "doc_id", "begin", "n"],
            )

    return docs.mapInArrow(run, f"anchor long, content long, doc_id {_kind(docs)}, begin int, n int")


def _opened(texts: DataFrame, k: int) -> DataFrame:
    """(anchor, edge, doc_id, pos) of the edges of the pieces that start at one of begins, of texts (doc_id, text, begins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = paths(*hashed_words(batch.column("text")), k)
            asked = [set(b) for b in batch.column("begins").to_pylist()]
            chosen = np.array([b in asked[t] for t, b in zip(p.text.tolist(), p.begin.tolist(), strict=True)], bool)
            n = p.n[chosen]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.repeat(p.anchor[chosen], n)), _signed(p.edges[np.repeat(p.first[chosen], n) + step]),
                    batch.column("doc_id").take(pa.array(np.repeat(p.text[chosen], n), pa.int64())), pa.array(np.repeat(p.begin[chosen], n) + step, pa.int32()),
                ],
                names=["anchor", "edge", "doc_id", "pos"],
            )

    return texts.mapInArrow(run, f"anchor long, edge long, doc_id {_kind(texts)}, pos int")


def _among(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that may have a doc_id of ids, the rest); the filter between them has a fixed size."""
    held = bit_filter(ids, "doc_id")
    told = passing(docs, held, "doc_id")
    return told.where("_passes").drop("_passes"), told.where("not _passes").drop("_passes")


def repeated_spans(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, begin, end): word spans [begin, end) covered by windows of k words whose sequence starts earlier as well.

    Earlier is a smaller doc_id, or the same one and an earlier word. Spans of a document may overlap. Rows with a null
    doc_id or text are left out. doc_id may be of any type that has an order, and must tell different texts apart.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    pieces = _pieces(docs, k)
    shared = settle(pieces.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"))
    held = bit_filter(shared, "anchor")
    met = settle(passing(pieces, held, "anchor").where("_passes").drop("_passes").join(shared, "anchor"))

    source = F.min(F.struct("doc_id", "begin")).alias("source")
    compact = settle(met.groupBy("anchor", "content").agg(source, F.count("*").alias("m")))
    again = compact.where("m > 1").select("anchor", "content", "source")
    own = (F.col("doc_id") == F.col("source.doc_id")) & (F.col("begin") == F.col("source.begin"))
    copies = met.join(again, ["anchor", "content"]).where(~own).select("doc_id", "begin", (F.col("begin") + F.col("n") + (k - 1)).alias("end"))

    branching = compact.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    begins = compact.join(branching, "anchor", "left_semi").groupBy("source.doc_id").agg(F.collect_set("source.begin").alias("begins"))
    begins = settle(begins)
    edges = settle(_opened(_among(docs, begins)[0].join(begins, "doc_id"), k))
    twice = settle(edges.groupBy("anchor", "edge").agg(F.min(F.struct("doc_id", "pos")).alias("source"), F.count("*").alias("m")).where("m > 1").select("anchor", "edge", "source"))
    some = passing(edges, bit_filter(twice, "anchor", "edge"), "anchor", "edge").where("_passes").drop("_passes")
    later = (F.col("doc_id") != F.col("source.doc_id")) | (F.col("pos") != F.col("source.pos"))
    single = some.join(twice, ["anchor", "edge"]).where(later).select("doc_id", F.col("pos").alias("begin"), (F.col("pos") + k).alias("end"))
    return copies.unionByName(single)


def _cut(text: str, spans: list[dict]) -> tuple[int, int, bytes]:
    """(words, removed words, the rest as UTF-8)."""
    words = text.encode().split()  # bytes.split() splits at the six blanks of this package
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["begin"]] += 1
        gone[s["end"]] -= 1
    left = np.cumsum(gone)[:-1] == 0
    return len(words), int((~left).sum()), b" ".join([w for w, x in zip(words, left.tolist(), strict=True) if x])


def _trimmed(rows: DataFrame, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t or "", s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = {
                "doc_id": ids.field(0) if pa.types.is_struct((ids := batch.column("doc_id")).type) else ids, "n_words": pa.array([c[0] for c in cut], pa.int64()), "n_removed": pa.array([c[1] for c in cut], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(c[2]).hexdigest() for c in cut], pa.string()),
            }
            if with_text:
                columns["kept_text"] = pa.array([c[2].decode() for c in cut], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, k: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_sha256, and with_text kept_text (the words that stay, by
    one space).

    A null text has no words. Rows with a null doc_id stay whole and are no source for others. Of rows that share a
    doc_id, different texts are documents of their own, in the order of a hash; equal ones are the same document and
    lose the same words. Other columns are not read.
    """
    docs = _told_apart(docs)
    spans = settle(repeated_spans(docs, k))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    kind = by_doc.schema["spans"].dataType
    touched, rest = _among(docs, spans.select("doc_id"))
    whole = rest.withColumn("spans", F.lit(None).cast(kind))
    return _trimmed(touched.join(by_doc, "doc_id", "left").select("doc_id", "text", "spans").unionByName(whole), with_text)
