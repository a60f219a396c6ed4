"""Pieces that several operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators.durable import Stored, scratch, settle  # noqa: F401

#: The six characters that the word and whitespace rules of this package treat as blank.
BLANKS = " \t\n\v\f\r"

try:
    _LIBC = ctypes.CDLL("libc.so.6")  # GNU systems; elsewhere freed memory is left to the allocator
except OSError:
    _LIBC = None

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SAME = np.arange(256, dtype=np.uint8)

#: Bits of a broadcast filter, at most: 1 << 19 rows of two longs.
MOST_BITS = 1 << 25

#: Bytes hashed at once; bounds the temporary arrays whatever the length of a text.
_SLICE = 1 << 19


class BitFilter(NamedTuple):
    """rows (word, mask) of a filter of so many bits; rows is None where it would let everything through."""

    rows: DataFrame | None
    bits: int


def bit_filter(keys: DataFrame, *columns: str) -> BitFilter:
    """A filter for the distinct keys given: 16 bits or more for each, as long as that makes MOST_BITS at most.

    It only saves work: a key that is not there passes by chance, more often the fuller the filter is. With as many
    keys as MOST_BITS there is none.
    """
    hashes = Stored(keys.select(F.xxhash64(*columns).alias("h")))
    n, bits = hashes.rows.count(), 1 << 16
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    rows = None
    if n < MOST_BITS:
        bit = F.pmod("h", F.lit(bits))
        set_ = hashes.rows.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("bit"))
        rows = settle(set_.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("mask")))
    hashes.free()
    return BitFilter(rows, bits)


def passing(df: DataFrame, held: BitFilter, *columns: str) -> DataFrame:
    """df with the column _passes: whether the filter may hold the key. The filter is broadcast: MOST_BITS / 64 rows at most."""
    if held.rows is None:
        return df.withColumn("_passes", F.lit(True))
    bit = F.pmod(F.xxhash64(*columns), F.lit(held.bits))
    met = df.withColumns({"_word": F.shiftright(bit, 6), "_bit": (bit % 64).cast("int")})
    met = met.join(F.broadcast(held.rows.withColumnsRenamed({"word": "_word", "mask": "_mask"})), "_word", "left")
    return met.withColumn("_passes", F.coalesce(F.getbit("_mask", F.col("_bit")) == 1, F.lit(False))).drop("_word", "_mask", "_bit")


def each_text(texts: pa.Array) -> Iterator[str]:
    """The texts one by one, null as empty, so that a batch is not held twice."""
    for text in texts:
        yield text.as_py() or ""


def row_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `size` bytes; a longer text stands alone."""
    low, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > low and held + n > size:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(texts):
        yield low, len(texts)


def give_back() -> None:
    """Hand memory that this worker has freed back to the system: workers are kept between tasks, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def unused_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    """The columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_column(df: DataFrame):
    """The text with null as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit words (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_weights = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _position_weights(n: int) -> np.ndarray:
    """Odd pseudo-random multipliers for the byte positions of a word, grown on demand."""
    global _weights
    if n > len(_weights):
        _weights = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _weights


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n+1 offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hash_slice(raw: np.ndarray, heads: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in raw; heads: positions where a text begins."""
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = heads[heads < len(raw)]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    spans = np.diff(np.append(starts, len(raw)))
    inside = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    parts = (fold[raw[starts[0] :]].astype(np.uint64) + np.uint64(1)) * _position_weights(int(spans.max()))[inside]
    parts *= solid[starts[0] :]
    return starts, mix64(np.add.reduceat(parts, starts - starts[0]))


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` of an array of texts, and the n+1 word offsets of the texts.

    lower folds A-Z only. Work arrays stay below a fixed size: bytes are taken in slices that end between words.
    """
    raw, at = utf8_parts(texts)
    fold = _LOWER if lower else _SAME
    starts, hashes, low = [], [], 0
    while low < len(raw):
        high = min(low + _SLICE, len(raw))
        while high < len(raw):
            # back to a place between two words; a text that is one long word is taken whole
            blanks = np.flatnonzero(_SPACE[raw[low:high]])
            heads = at[(at > low) & (at <= high)]
            cut = max([low, *(heads[-1:]), *(low + blanks[-1:] + 1)])
            if cut > low:
                high = int(cut)
                break
            high = min(high + _SLICE, len(raw))
        s, h = _hash_slice(raw[low:high], at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low, fold)
        starts.append(s + low)
        hashes.append(h)
        low = high
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, at, side="left").astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive words; entry i begins at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix64(out + words[j : n + j] * np.uint64(2 * j + 1) + np.uint64(j + 1))
    return out


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int):
    """Per text the sorted distinct shingle hashes; fewer than k words make one shingle, no words none."""
    all_hashes = shingle_hashes(words, k)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(all_hashes[lo : hi - k + 1])
        elif hi > lo:
            yield shingle_hashes(words[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def lists_of_longs(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> column from arrays of unsigned 64-bit words."""
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))


class Uncut(Exception):
    """A text that may not be encoded word by word."""


class WordMemory:
    """What make(word) gives for words, remembered in two generations of a bounded size: a full young one becomes the
    old one, and words met again move back, so that frequent words stay."""

    def __init__(self, make, size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def _find(self, word: str) -> bytes:
        value = self.young.get(word)
        if value is None:
            value = self.old.get(word)
            if value is None:
                value = self.make(word)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[word] = value
        return value

    def all(self, words: list[str]) -> list[bytes]:
        out = list(map(self.young.get, words))
        if None in out:
            out = [self._find(w) if v is None else v for w, v in zip(words, out, strict=True)]
        return out
