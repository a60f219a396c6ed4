"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of the same scale can be
merged by union, and shares of common hashes estimate likeness and containment even between very unequal texts. A text
whose hashes all lie above the threshold keeps its smallest one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import hashed_words, shingle_sets

SHINGLE = 5
#: One in so many shingle hashes is kept.
SCALE = 8
#: Bytes of texts in one range of ids, about.
RANGE = 32 << 20
#: Ranges at most, and ids drawn for each to set its bounds.
RANGES, DRAWN = 8192, 64


def sketches(texts: pa.Array, k: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted sketch of each text, as the upper 32 bits of its hashes; a text without words has an empty one."""
    words, at = hashed_words(texts)
    out, limit = [], np.uint32((1 << 32) // scale)
    for hashes in shingle_sets(words, at, k):
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        n = int(np.searchsorted(high, limit))
        kept = high[: max(n, 1)] if len(high) else high
        out.append(kept[np.r_[True, kept[1:] != kept[:-1]]] if len(kept) else kept)
    return out


def encoded(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def decoded(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u4")


def _above(sketch: np.ndarray, scale: int = SCALE) -> bool:
    """Whether the sketch is the one hash of a text that has none below the threshold."""
    return len(sketch) == 1 and int(sketch[0]) >= (1 << 32) // scale


def _united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union: a hash above the threshold stays only where there is none below it."""
    both = np.union1d(a, b)
    below = both[both < (1 << 32) // SCALE]
    return below if len(below) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two texts from their sketches; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - common
    return common / whole if whole else 1.0


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Column function: the fingerprint of a text (null as empty). Equal texts have equal fingerprints."""
    return pa.array([encoded(s) for s in sketches(texts)], pa.string())


@F.arrow_udf(T.DoubleType())
def containment(inner: pa.Array, outer: pa.Array) -> pa.Array:
    """Column function: estimated share of the first text's shingles that the second holds; 1 for an empty first, null
    where the first has no hash below the threshold but the second has, so that nothing can be said."""
    pairs = [(decoded(a), decoded(b)) for a, b in zip(inner.to_pylist(), outer.to_pylist(), strict=True)]
    told = [None if _above(a) and not _above(b) and len(b) else len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0 for a, b in pairs]
    return pa.array(told, pa.float64())


@F.arrow_udf(T.StringType())
def merged(one: pa.Array, other: pa.Array) -> pa.Array:
    """Column function: the fingerprint of the union of two texts' shingles, the same as if it were made from them."""
    return pa.array([encoded(_united(decoded(a), decoded(b))) for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True)], pa.string())


def _ranges(docs: DataFrame, n: int, parts: int) -> tuple[list[int], dict[int, int | None]]:
    """Bounds that cut n ids into about `parts` equal ranges, and for each range that has rows the first id after it.

    The last range gets the smallest id of all. Bounds come from ids drawn by hash, about DRAWN a range, and one row a
    range comes back, so that the driver holds some RANGES * DRAWN ids at most, however large docs is.
    """
    known = docs.where("doc_id is not null")
    share = int((1 << 30) * min(1.0, parts * DRAWN / max(n, 1)))
    drawn = sorted(r[0] for r in known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("doc_id").distinct().collect())
    bounds = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    firsts = known.groupBy(_range_of(bounds)(F.col("doc_id")).alias("part")).agg(F.min("doc_id").alias("first"))
    rows = sorted((r["part"], r["first"]) for r in firsts.collect())
    return bounds, {part: rows[(i + 1) % len(rows)][1] for i, (part, _) in enumerate(rows)}


def _range_of(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    @F.arrow_udf(T.IntegerType())
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32), pa.int32())

    return part


def with_next(docs: DataFrame, per_batch, schema: str, parts: int | None = None) -> DataFrame:
    """Rows of schema that per_batch(doc_ids, texts, next_texts) makes of each text and the one with the next larger doc_id.

    After the largest id comes the smallest. Rows with the same id follow each other by text; a row with a null id is
    its own next. Texts are shuffled once, by ranges of ids of about RANGE bytes, or by RANGES larger ones; a task sorts its range, spilling,
    and holds one batch of it. The first row of each range also goes to the range before.
    """
    spark = docs.sparkSession
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    if parts is None:
        parts = min(RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE)))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, following = _ranges(docs, n, parts)
    known = docs.where("doc_id is not null").withColumns({"part": _range_of(bounds)(F.col("doc_id")), "guest": F.lit(False)})
    homes = spark.createDataFrame([(first, part) for part, first in following.items()], "doc_id long, part int")
    guests = docs.join(F.broadcast(homes), "doc_id").select("doc_id", "text", "part", F.lit(True).alias("guest"))
    alone = docs.where("doc_id is null").select("doc_id", "text", F.lit(-1).alias("part"), F.lit(False).alias("guest"))
    dealt = known.unionByName(guests).unionByName(alone).repartition(parts, "part").sortWithinPartitions("part", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next: part, guest, id, text
        for batch in batches:
            ids, texts, nexts = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")]
            for row in zip(*columns, strict=True):
                if held is not None and not held[1] and held[0] >= 0:
                    if held[0] != row[0]:
                        raise ValueError("a range of ids came without the first row after it")
                    ids.append(held[2]), texts.append(held[3]), nexts.append(row[3])
                if row[0] < 0:
                    ids.append(row[2]), texts.append(row[3]), nexts.append(row[3])
                held = row
            if ids:
                yield from per_batch(ids, texts, nexts)

    return dealt.mapInArrow(run, schema)


def _edited(ids: list, texts: list[str], nexts: list[str]) -> Iterator[pa.RecordBatch]:
    changed = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
    own, other, after = (sketches(pa.array(x, pa.large_string())) for x in (texts, changed, nexts))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([encoded(s) for s in own], pa.string()), pa.array([encoded(s) for s in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edit_report(docs: DataFrame) -> DataFrame:
    """For each row of docs its fingerprint, that of the text with its last quarter replaced by the start of the next
    document, and their likeness. A null text is empty; repeated rows stay; other columns are not read."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, _edited, schema)
