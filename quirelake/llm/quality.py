"""Quality classifier: naive Bayes support vectors.

Features are the hashed byte n-grams (one to three) that a text holds, and bigrams of one word repeated, by their share
of the text's bigrams, as 0/1 indicators. Each is scaled by the logarithm of the ratio of its smoothed class frequencies, and a linear hinge-loss model over the scaled indicators is
fitted by dual coordinate descent. A sigmoid fitted on rows that the model has not seen turns margins into likelihoods.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import hashed_words, utf8_parts
from quirelake.llm.linear import fit_hinge, fit_sigmoid

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 5000
#: Size of the hashed feature space, and the shares of repeated words that have a feature of their own after it.
SPACE = 1 << 15
REPEATED = (0.0, 0.02, 0.1, 0.3)
SIZE = SPACE + len(REPEATED)
_CUT = 1 << 20


def _present(raw: np.ndarray) -> np.ndarray:
    """Sorted features of the n-grams of one text; long texts are taken in slices."""
    flags = np.zeros(SPACE, bool)
    for low in range(0, len(raw), _CUT):
        c = raw[low : low + _CUT + 2].astype(np.uint32)
        flags[c & np.uint32(SPACE - 1)] = True
        if len(c) > 1:
            two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x1B873593)
            flags[((two ^ (two >> np.uint32(13))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)) & np.uint32(SPACE - 1)] = True
        if len(c) > 2:
            three = two[:-1] * np.uint32(0xCC9E2D51) + c[2:] * np.uint32(0xC2B2AE35)
            flags[((three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39) >> np.uint32(16)) & np.uint32(SPACE - 1)] = True
    return np.flatnonzero(flags)


def _each(texts: pa.Array):
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    raw, at = utf8_parts(texts)
    words, first = hashed_words(texts)
    for lo, hi, a, b in zip(at[:-1], at[1:], first[:-1], first[1:], strict=True):
        share = float((words[a + 1 : b] == words[a : b - 1]).mean()) if b - a > 1 else 0.0
        yield np.append(_present(raw[lo:hi]), [SPACE + i for i, x in enumerate(REPEATED) if share > x]).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def features(texts: pa.Array) -> pa.Array:
    """The features of each text, sorted."""
    return pa.array([x.astype(np.int32) for x in _each(texts)], pa.list_(pa.int32()))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b) from labelled rows; a constant score where a class has no rows.

    A label met twice counts once; of rows of docs that share a doc_id one text is learned from. At most SAMPLE sets of
    features come to the driver.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE ids
    joined = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted((r[0], r[1], r[2]) for r in joined.select("doc_id", "quality", features(F.col("text"))).collect())
    y = np.array([r[1] for r in rows], int)
    if len(set(y)) < 2:
        return np.zeros(SIZE), 0.0, 1.0, 2.0 if 1 in y else (-2.0 if len(y) else 0.0)
    sets = [np.array(r[2], np.int64) for r in rows]
    test = np.arange(len(y)) % 4 == 3
    seen = {c: np.ones(SIZE) for c in (0, 1)}
    for x, c, t in zip(sets, y, test, strict=True):
        if not t:
            seen[c][x] += 1
    size = {c: int(((y == c) & ~test).sum()) + 2 for c in (0, 1)}
    ratio = np.log((seen[1] / size[1]) / (seen[0] / size[0]))
    data = [(x, ratio[x] / np.sqrt(max(len(x), 1))) for x in sets]
    train = [i for i in range(len(y)) if not test[i]]
    share = {c: max(1, int((y[train] == c).sum())) for c in (0, 1)}
    cost = np.array([len(train) / (2 * share[y[i]]) for i in train])
    w = fit_hinge([data[i] for i in train], np.where(y[train] == 1, 1.0, -1.0), SIZE, cost, epochs=25)
    margin = np.array([w[x] @ v + w[-1] for x, v in data])
    a, b = fit_sigmoid(margin[test], y[test] == 1) if len(set(y[test])) == 2 else (1.0, 0.0)
    return w[:-1] * ratio, float(w[-1]), a, b


def scorer(model: tuple[np.ndarray, float, float, float]):
    """A column function text -> likelihood of label 1, in 0..1, for any text (null as empty)."""
    weights, bias, a, b = model

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        margin = np.array([weights[x].sum() / np.sqrt(max(len(x), 1)) + bias for x in _each(texts)], float)
        return pa.array(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))), pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted. Learns from labels of rows that are not held out; scores read the text alone.

    Rows pass through one by one: repeated rows and null keys stay; columns of the same names are replaced. With no
    usable label of one class every score is the same.
    """
    score = scorer(fit(docs, labels))
    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
