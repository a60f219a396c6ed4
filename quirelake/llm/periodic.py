"""Periodic runs in texts, by a dictionary of basic factors.

The words of a text are named, then factors of two, four, eight ... words by the pair of names of their halves; a factor
that occurs once only in its text is left out, and with it all that hold it. Per length, occurrences that follow each
other within twice that length, in an arithmetic progression of three or more, propose their difference as a period. The
proposals are extended word by word as far as the period holds, and counted once.

A run of period q and length 4 * q or more is proposed by the length from q up to below 2 * q: there a factor's next
occurrence inside the run is q words on, never fewer, so that no period proposed is a multiple of a smaller one.
Words are compared by 64-bit hashes: two different words of a text of n words are taken as one with odds below n * n / 2^64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import _SPACE, hashed_words, row_slices, utf8_parts

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Bytes of texts worked on at once (a longer text is taken alone), and words copied at once.
_SLICE, _COPY = 1 << 22, 1 << 17


def _ordered(keys: np.ndarray) -> np.ndarray:
    """The places of keys by key, then place."""
    bits, top = max(len(keys) - 1, 1).bit_length(), int(keys.max(initial=0))
    if top.bit_length() + bits > 64:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _proposals(p: np.ndarray, step: np.ndarray, span: int, least: int, times: int) -> list[tuple[int, int]]:
    """(start, period): of neighbouring starts of progressions of one difference the first, where together they are long enough."""
    i = np.flatnonzero((step[:-1] > 0) & (step[:-1] == step[1:]))
    first, period = p[i], step[i]
    order = np.lexsort((first, period))
    first, period = first[order], period[order]
    heads = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (first[1:] != first[:-1] + 1)]) if len(first) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(first)))
    first, period = first[heads], period[heads]
    enough = 2 * period + span + counts - 1 >= np.maximum(least, times * period)
    return list(zip(first[enough].tolist(), period[enough].tolist(), strict=True))


def _agree(h: np.ndarray, at: int, by: int, most: int, way: int) -> int:
    """How many words from `at` on (way 1) or before it (way -1) equal those `by` words on, at most `most`."""
    told, size = 0, 64
    while told < most:
        n = min(size, most - told)
        low = at + told if way > 0 else at - told - n
        same = h[low : low + n] == h[low + by : low + by + n]
        if not same.all():
            return told + int(np.argmin(same if way > 0 else same[::-1]))
        told, size = told + n, 2 * size
    return told


def runs_of(h: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of each run in the texts whose words' hashes are h[at[i]:at[i + 1]], by start, then period.

    times must be 4 or more: below that the proof above does not hold.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found by this method")
    ends = np.repeat(at[1:], np.diff(at))
    longest, found = int(np.diff(at).max(initial=0)), {}
    names = np.full(len(h), -1, np.int64)
    held = np.zeros(0, np.int64)  # the places that have names
    pos, keys, span = np.arange(len(h)), h, 1
    while len(pos) and 2 * span <= longest:
        order = _ordered(keys)
        p, k = pos[order], keys[order]
        new = np.r_[True, k[1:] != k[:-1]]
        gap = np.diff(p)
        linked = ~new[1:] & (p[1:] < ends[p[:-1]])
        last = None
        for start, q in _proposals(p, np.where(linked & (gap <= 2 * span), gap, 0), span, least, times):
            if last is not None and last[1] == q and start + q <= last[0]:
                continue  # in the run just extended
            text = int(np.searchsorted(at, start, side="right")) - 1
            low = start - _agree(h, start, q, start - int(at[text]), -1)
            high = start + q + _agree(h, start, q, int(at[text + 1]) - q - start, 1)
            last = (high, q)
            if high - low >= max(least, times * q):
                found[low, q] = high - low
        again = np.r_[linked, False] | np.r_[False, linked]
        names[held] = -1
        held = np.sort(p[again])
        names[p[again]] = (np.cumsum(new) - 1)[again]
        first = held[held + span < ends[held]]
        first = first[names[first + span] >= 0]
        pos, keys, span = first, names[first] * np.int64(len(h)) + names[first + span], 2 * span
    return np.array(sorted((low, length, q) for (low, q), length in found.items()), np.int64).reshape(-1, 3)


def _word_ends(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts raw[at[i]:at[i + 1]] starts and ends."""
    solid = ~_SPACE[raw]
    bounds = at[(at > 0) & (at < len(raw))]
    fresh, over = np.r_[True, ~solid[:-1]], np.r_[~solid[1:], True]
    fresh[bounds], over[bounds - 1] = True, True
    return np.flatnonzero(solid & fresh[: len(raw)]), np.flatnonzero(solid & over[-len(raw) :]) + 1 if len(raw) else np.zeros(0, np.int64)


def _joined(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of counts[i] words each, joined by one space."""
    parts, padded = [], np.append(raw, np.uint8(0x20))
    for low in range(0, len(starts), _COPY):
        s, n = starts[low : low + _COPY], sizes[low : low + _COPY] + 1
        out = np.cumsum(n) - n
        piece = padded[np.repeat(s - out, n) + np.arange(int(n.sum()))]
        piece[out + n - 1] = 0x20
        parts.append(piece)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    till = np.r_[0, np.cumsum(sizes + 1)][np.r_[0, np.cumsum(counts)]]
    # the space after each text's last word goes
    keep = np.ones(len(data), bool)
    keep[till[1:][counts > 0] - 1] = False
    data, offsets = data[keep], till - np.r_[0, np.cumsum(counts > 0)]
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def _worked(ids: list, texts: pa.Array, rewrite: Callable | None, least: int, times: int) -> list[pa.Array]:
    raw, byte_at = utf8_parts(texts)
    starts, ends = _word_ends(raw, byte_at)
    h, at = hashed_words(texts)
    source = np.arange(len(h))
    if rewrite is not None:
        for i, (low, high) in zip(ids, zip(at[:-1].tolist(), at[1:].tolist(), strict=True), strict=True):
            if high > low and (other := rewrite(i, high - low)) is not None:
                source[low:high] = low + other
        h = h[source]
    runs = runs_of(h, at, least, times)
    dropped = np.zeros(len(h), bool)
    for start, length, q in runs.tolist():
        dropped[start + q : start + length] = True
    kept = ~dropped
    left = np.diff(np.r_[0, np.cumsum(kept)][at])
    words = source[kept]
    text = np.searchsorted(at, runs[:, 0], side="right") - 1
    runs[:, 0] -= at[text]
    tuples = pa.StructArray.from_arrays([pa.array(runs[:, i], pa.int64()) for i in range(3)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), tuples)
    return [pa.array(np.diff(at), pa.int64()), lists, _joined(raw, starts[words], (ends - starts)[words], left)]


def find_runs(docs: DataFrame, rewrite: Callable | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row a row of docs: doc_id, n_words, runs, collapsed.

    A run is a stretch of consecutive words `[^\\x20\\x09-\\x0D]+` with smallest period q and a length of at least `least`
    and times * q words, which neither neighbouring word extends. runs: array of (start, length, period), by start, then
    period; collapsed: the words joined by one space, without those that any run holds after its first q words.
    rewrite(doc_id, n) may give the indices of the words to judge in place of the n words there, or None.

    A null or blank text has no words, no runs and an empty collapsed text. Rows are judged each for itself, repeated
    ones as well; a null doc_id stays; other columns are not read. A text is held whole in its task, about 60 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_slices(batch.column(1), _SLICE):
                some = batch.slice(low, high - low)
                ids = some.column(0)
                yield pa.RecordBatch.from_arrays([ids, *_worked(ids.to_pylist(), some.column(1), rewrite, least, times)], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_run(runs):
    """Column: of an array of runs the one with the greatest exact length / period; ties: smallest start, then period; null for none."""
    def better(a, b):
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (other > one) | ((other == one) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))), b).otherwise(a)

    return F.reduce(runs, F.get(runs, F.lit(0)), better)
