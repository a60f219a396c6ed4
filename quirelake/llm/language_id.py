"""Language ID by hierarchical discrimination: the language family first, then the language within it.

Features are hashed byte trigrams of the lower-cased letters, as shares of a text's trigrams. One-versus-one linear
support vector machines vote for the family, then others vote among the languages of that family. They are fitted on
a bounded sample of labelled rows; prediction is a column expression over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quirelake.llm.common import give_back, row_slices, unused_name, utf8_parts
from quirelake.llm.linear import fit_hinge

#: Labelled rows a language that the models are fitted on, at most: those with the smallest hash of their id.
SAMPLE = 250
#: Size of the hashed feature space.
SPACE = 1 << 15
#: Bytes that one training piece holds at most, and pieces of one sample text, at most, at even distances.
PIECE, PIECES = 400, 40

# Families of languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "celtic": "br cy ga gd",
    "austronesian": "id jv ms tl",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_CUT = 1 << 20


@dataclass
class Model:
    """pairs: for each (group, one, other) the weights' row; group is "" for families."""

    langs: list[str]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    bias: np.ndarray


def _slots(raw: np.ndarray) -> np.ndarray:
    """Feature of the trigram at each place but the last two."""
    c = _LETTER[raw].astype(np.uint32)
    x = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(16)) & np.uint32(SPACE - 1)


def _sums(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sums of the weights' rows over its trigrams, and their number; bytes are taken in slices."""
    raw, at = utf8_parts(pc.utf8_lower(pc.fill_null(texts, "")))
    total, count = np.zeros((len(at) - 1, len(weights))), np.maximum(np.diff(at) - 2, 0)
    for low in range(0, max(len(raw) - 2, 0), _CUT):
        high = min(low + _CUT, len(raw) - 2)
        slots = _slots(raw[low : high + 2])
        first, last = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high, "left")
        begins = np.clip(at[first:last], low, high) - low
        ends = np.clip(at[first + 1 : last + 1] - 2, low, high) - low
        for k, w in enumerate(weights):
            run = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
            total[first:last, k] += np.where(ends > begins, run[np.maximum(ends, begins)] - run[begins], 0.0)
    return total, count


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _pieces(texts: pa.Array) -> pa.Array:
    """PIECES pieces of each lower-cased text, or all if it has no more."""
    raw, at = utf8_parts(pc.utf8_lower(pc.fill_null(texts, "")))
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        starts = range(low, high, PIECE)
        starts = [starts[i * len(starts) // PIECES] for i in range(PIECES)] if len(starts) > PIECES else starts
        parts = [raw[x : min(x + PIECE, high)] for x in starts]
        out.append([p.tobytes() for p in parts if len(p) >= (PIECE // 4 if high - low > PIECE else 3)])
    return pa.array(out, pa.list_(pa.binary()))


def _counted(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(_slots(np.frombuffer(piece, np.uint8)), return_counts=True)
    return at, n / n.sum() * 20


def sample(docs: DataFrame) -> list[tuple[str, list[bytes]]]:
    """(lang, pieces) of at most SAMPLE rows for each language, however many there are; of rows that share doc_id and
    lang one text is taken. What comes to the driver has at most SAMPLE * PIECES * PIECE bytes a language."""
    named = docs.where("lang is not null and text is not null and doc_id is not null")
    spread = F.xxhash64("doc_id", "lang")
    ids = named.select("lang", "doc_id", F.dense_rank().over(W.partitionBy("lang").orderBy(spread, "doc_id")).alias("nth"))
    chosen = F.broadcast(ids.where(F.col("nth") <= SAMPLE).select("lang", "doc_id").distinct())  # at most SAMPLE ids a language
    texts = named.join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["pieces"]) for r in texts.select("lang", _pieces("text").alias("pieces")).collect())


def fit(docs: DataFrame) -> Model:
    """A model from the labelled rows of docs (doc_id, text, lang); without such rows it knows no language."""
    by_lang: dict[str, list] = {}
    for lang, pieces in sample(docs):
        by_lang.setdefault(lang, []).extend(map(_counted, pieces))
    by_lang = {k: v for k, v in by_lang.items() if v}
    family = {lang: _FAMILY.get(lang, lang) for lang in by_lang}
    groups = {"": {f: [p for x in sorted(by_lang) if family[x] == f for p in by_lang[x]] for f in sorted(set(family.values()))}}
    for f in groups[""]:
        groups[f] = {lang: by_lang[lang] for lang in sorted(by_lang) if family[lang] == f}
    pairs, weights = [], []
    for group, members in groups.items():
        for a, b in combinations(members, 2):
            n, m = len(members[a]), len(members[b])
            cost = np.r_[np.full(n, (n + m) / (2 * n)), np.full(m, (n + m) / (2 * m))]
            pairs.append((group, a, b))
            weights.append(fit_hinge(members[a] + members[b], np.r_[np.ones(n), -np.ones(m)], SPACE, cost, epochs=8))
    w = np.array(weights) if weights else np.zeros((0, SPACE + 1))
    return Model(sorted(by_lang), pairs, np.ascontiguousarray(w[:, :-1]), w[:, -1])


def _vote(members: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the member with most votes (ties: the larger sum of margins) and a likelihood in 0..1."""
    votes, sums, least = np.zeros((n, len(members))), np.zeros((n, len(members))), np.full((n, len(members)), 30.0)
    for (a, b), m in margins.items():
        for k, s in ((members.index(a), m), (members.index(b), -m)):
            votes[:, k] += s > 0
            sums[:, k] += s
            least[:, k] = np.minimum(least[:, k], s)
    best = np.argmax(votes + sums / (np.abs(sums).max() * 4 + 1), axis=1)
    return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(n), best], -15, 15)))


def _lettered(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}")


@F.arrow_udf(T.BooleanType())
def has_letter(texts: pa.Array) -> pa.Array:
    """Whether a text has a letter; false for null."""
    return _lettered(texts)


def predictor(model: Model):
    """A column function text -> struct(lang, score); `und` with score 0 for null or letterless text or an empty model."""
    families = sorted({_FAMILY.get(x, x) for x in model.langs})

    def told(texts: pa.Array) -> pa.StructArray:
        n = len(texts)
        langs, scores = np.full(n, "und", dtype=object), np.zeros(n)
        lettered = np.asarray(_lettered(texts).to_numpy(zero_copy_only=False), bool)
        if model.langs and n:
            total, count = _sums(texts, model.weights)
            margin = total / np.maximum(count, 1)[:, None] * 20 + model.bias
            rows = {(g, a, b): margin[:, k] for k, (g, a, b) in enumerate(model.pairs)}
            best, sure = _vote(families, {(a, b): m for (g, a, b), m in rows.items() if g == ""}, n)
            for k, f in enumerate(families):
                members = [x for x in model.langs if _FAMILY.get(x, x) == f]
                own, p = _vote(members, {(a, b): m for (g, a, b), m in rows.items() if g == f}, n)
                hit = (best == k) & lettered
                langs[hit] = np.array(members, dtype=object)[own][hit]
                scores[hit] = (sure * p)[hit]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        parts = [told(texts.slice(low, high - low)) for low, high in row_slices(texts, 4 * _CUT)]
        give_back()
        return pa.concat_arrays(parts) if parts else told(texts)

    return predict


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(base: DataFrame) -> Model:
    return fit(base.where(~held_out(F.col("doc_id"))))


def _told(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with a column struct(lang, score), and that column's name, which no other has."""
    name = unused_name(docs, "_lang")
    return docs.withColumn(name, predictor(model)(F.col("text"))), name


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with lang_pred and score. Only text is read for that; learn_from (default docs) gives text, lang and doc_id.

    Rows held out by held_out() are not learned from. Rows pass through one by one: repeated rows and null keys stay;
    columns named lang_pred or score are replaced.
    """
    told, name = _told(docs, _learned(docs if learn_from is None else learn_from))
    return told.withColumns({"lang_pred": F.col(f"{name}.lang"), "score": F.col(f"{name}.score")}).drop(name)


def keep_identified(docs: DataFrame, least: float = 0.0, fill: bool = False) -> DataFrame:
    """The rows of docs whose language is known (not `und`) with at least that score; columns as they came.

    With fill a null lang becomes the predicted one. Where no row has a usable label no model can be fitted, and all
    rows with a letter stay as they are.
    """
    model = _learned(docs)
    if not model.langs:
        return docs.where(has_letter("text"))
    # a deterministic function would be called twice, for the condition and for its answer, in two workers a task
    name = unused_name(docs, "_lang")
    told = docs.withColumn(name, predictor(model).asNondeterministic()(F.col("text")))
    kept = told.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= least))
    return (kept.withColumn("lang", F.coalesce("lang", F.col(f"{name}.lang"))) if fill else kept).drop(name)
