"""Secret scan: fixed base patterns, and formats learned by grammar inference.

The values that the base patterns find are labelled credentials. A prefix tree over their character classes is merged
into a probabilistic automaton: a state joins another when the frequencies of ending and of each next symbol agree
within Hoeffding bounds, for them and all states below. A second automaton is learned from other tokens of that
shape. Every candidate of every text is scored by its mean log likelihood a character under the first automaton:
values of base spans, and what they leave of each run of credential characters, whole and in its parts between `=` and
`/`. One of the latter becomes a span if it is as likely as nearly all labelled credentials and likelier than under the
second automaton.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quirelake.llm.common import each_text, give_back, unused_name

#: Distinct labelled credentials, and as many other tokens, that the automata are learned from, at most: those with the smallest hash.
SAMPLE = 1500
#: Levels of the prefix tree, at most; of a longer credential the first symbols are learned, and no end.
DEPTH = 400
#: Characters of a candidate, at least.
SHORTEST = 8
#: Scores of shapes that an automaton remembers in a worker, at most.
REMEMBERED = 200_000
#: Share of the labelled credentials that may score below the threshold.
SPARE = 0.01
#: Confidence of the merge test.
ALPHA = 0.05

KINDS = ("assign", "access", "hex", "format")

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_PART = re.compile(r"[A-Za-z0-9+_.-]{8,}")

_SHAPE = str.maketrans("0123456789abcdef" + "ghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h" * 16 + "w" * 20 + "W" * 26)
_SIZE = {"h": 16, "w": 20, "W": 26}
_SYMBOLS = 9  # three classes, six other characters of a run


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, leftmost and non-overlapping for each kind, in code points."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, str]]:
    """(start, value) of what base spans leave of each run of credential characters."""
    if base:
        chars = list(text)
        for a, b, _, _ in base:
            chars[a:b] = " " * (b - a)
        text = "".join(chars)
    return [(m.start(), m[0]) for m in _RUN.finditer(text)]


class Automaton:
    """A probabilistic automaton over character classes: states 0.. with counts of ends and of symbols, and next states."""

    def __init__(self, ends: list[int], seen: list[dict[str, int]], after: list[dict[str, int]]):
        self.ends, self.seen, self.after = ends, seen, after
        self.total = [e + sum(s.values()) for e, s in zip(ends, seen, strict=True)]

    def score(self, value: str) -> float:
        """Mean log2 likelihood a character, ends included; symbols unseen in a state have add-one-half counts and stay in it."""
        shape = value.translate(_SHAPE)
        known = self.__dict__.setdefault("known", {})
        if shape not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[shape] = self._score(shape)
        return known[shape]

    def _score(self, shape: str) -> float:
        state, bits = 0, 0.0
        for kind in shape:
            full = self.total[state] + 0.5 * (_SYMBOLS + 1)
            bits += math.log2((self.seen[state].get(kind, 0) + 0.5) / full / _SIZE.get(kind, 1))
            state = self.after[state].get(kind, state)
        bits += math.log2((self.ends[state] + 0.5) / (self.total[state] + 0.5 * (_SYMBOLS + 1)))
        return bits / (len(shape) + 1)


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton for a sample: its prefix tree with statistically compatible states merged, breadth first."""
    ends, seen, after = [0], [Counter()], [{}]
    for value in values:
        state = 0
        for kind in value[:DEPTH].translate(_SHAPE):
            seen[state][kind] += 1
            if kind not in after[state]:
                after[state][kind] = len(ends)
                ends.append(0), seen.append(Counter()), after.append({})
            state = after[state][kind]
        ends[state] += len(value) <= DEPTH
    total = [e + sum(s.values()) for e, s in zip(ends, seen, strict=True)]
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > spread * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        """b is the root of a tree."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if differ(ends[p], total[p], ends[q], total[q]):
                return False
            if any(differ(seen[p][k], total[p], seen[q][k], total[q]) for k in {*seen[p], *seen[q]}):
                return False
            todo += [(after[p][k], n) for k, n in after[q].items() if k in after[p]]
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree under b to the states from a on."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            ends[p] += ends[q]
            total[p] += total[q]
            seen[p].update(seen[q])
            for k, n in after[q].items():
                if k in after[p]:
                    todo.append((after[p][k], n))
                else:
                    after[p][k] = n

    kept, fringe = [0], [(0, k) for k in sorted(after[0])]
    while fringe:
        fringe.sort(key=lambda x: -total[after[x[0]][x[1]]])
        source, kind = fringe.pop(0)
        state = after[source][kind]
        if state in kept:
            continue
        home = next((r for r in kept if compatible(r, state)), None)
        if home is None:
            kept.append(state)
            fringe += [(state, k) for k in sorted(after[state]) if after[state][k] not in kept]
        else:
            after[source][kind] = home
            before = {(r, k) for r in kept for k in after[r]}
            fold(home, state)
            fringe += [(r, k) for r in kept for k in sorted(after[r]) if (r, k) not in before and after[r][k] not in kept]
    number = {s: i for i, s in enumerate(kept)}
    return Automaton([ends[s] for s in kept], [dict(seen[s]) for s in kept], [{k: number[n] for k, n in after[s].items()} for s in kept])


_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))


def _hashed(value: str) -> tuple[int, str]:
    return zlib.crc32(value.encode()), value


def _least(values: set[str]) -> list[str]:
    """The SAMPLE values with the smallest hash."""
    return sorted(values, key=_hashed)[:SAMPLE]


@F.arrow_udf(_FOUND)
def _labelled(texts: pa.Array) -> pa.Array:
    """The labelled credentials of each text; with the first text also the SAMPLE other candidates of the whole batch
    that have the smallest hash, which is all that the sample of all texts can take from it."""
    out, pool = [], set()
    for text in each_text(texts):
        base = base_spans(text)
        out.append([{"kind": "credential", "value": v} for _, _, _, v in base])
        pool.update(v for _, v in candidates(text, base))
        if len(pool) > 16 * SAMPLE:
            pool = set(_least(pool))
    if out:
        out[0] = out[0] + [{"kind": "other", "value": v} for v in _least(pool)]
    give_back()
    return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))


def fit(docs: DataFrame) -> tuple[Automaton, Automaton, float] | None:
    """(automaton of credentials, automaton of other tokens, threshold), or None if the texts hold no credential.

    One scan; a bounded sample of distinct values comes to the driver. Repeated rows give no value twice.
    """
    found = docs.select(F.explode(_labelled(F.col("text"))).alias("v")).select("v.kind", "v.value").distinct()
    nth = F.row_number().over(W.partitionBy("kind").orderBy(F.crc32(F.col("value").cast("binary")), "value"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= SAMPLE).select("kind", F.left("value", F.lit(DEPTH + 1)).alias("value")).collect()
    good, other = (sorted(r["value"] for r in rows if r["kind"] == kind) for kind in ("credential", "other"))
    if not good:
        return None
    grammar = infer(good)
    scores = sorted(grammar.score(v) for v in good if len(v) <= DEPTH) or [0.0]
    return grammar, infer(other), scores[int(len(scores) * SPARE)]


def _taken(model: tuple[Automaton, Automaton, float], at: int, value: str) -> list[tuple[int, int, str, float]]:
    """The spans of a candidate run: the whole, or those of its parts that are likelier."""
    grammar, other, least = model

    def told(begin: int, part: str) -> list[tuple[int, int, str, float]]:
        score = grammar.score(part)
        return [(begin, begin + len(part), "format", score)] if score >= least and score > other.score(part) else []

    found = told(at, value)
    trimmed = value.rstrip(".=/").lstrip(".=/-")
    if len(trimmed) >= SHORTEST and (trimmed != value or "=" in value or "/" in value):
        parts = [told(at + m.start(), m[0]) for m in _PART.finditer(value)]
        for other_way in (told(at + value.index(trimmed), trimmed), [s for p in parts for s in p]):
            if other_way and (not found or max(s[3] for s in other_way) > max(s[3] for s in found)):
                found = other_way
    return found


def spans_of(text: str, model: tuple[Automaton, Automaton, float] | None) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, score) by start, then kind; without a model there are base kinds alone and no scores."""
    base = base_spans(text)
    spans = [(a, b, kind, model[0].score(value) if model else None) for a, b, kind, value in base]
    for at, value in candidates(text, base) if model else ():
        spans += _taken(model, at, value)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def span_finder(model: tuple[Automaton, Automaton, float] | None):
    """A column function text -> array of (start, end, kind, score) as of spans_of."""

    @F.arrow_udf(_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        out = [[{"start": a, "end": b, "kind": k, "score": p} for a, b, k, p in spans_of(text, model)] for text in each_text(texts)]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])))

    return find


def redactor(model: tuple[Automaton, Automaton, float] | None):
    """A column function text -> the text with `[REDACTED]` for each of its spans, null where it has none."""

    @F.arrow_udf(T.StringType())
    def redacted(texts: pa.Array) -> pa.Array:
        out = []
        for text in each_text(texts):
            found = spans_of(text, model)
            parts, at = [], 0
            for a, b, _, _ in found:
                if b > at:
                    parts += [text[at : max(a, at)], "[REDACTED]" if a >= at else ""]
                    at = b
            out.append("".join([*parts, text[at:]]) if found else None)
        give_back()
        return pa.array(out, pa.string())

    return redacted


def scan(docs: DataFrame) -> DataFrame:
    """docs with secrets, the spans found in each whole text. A null text has none; rows pass through one by one, so
    repeated rows and null keys stay, and a column named secrets is replaced. The automata are learned from docs."""
    return docs.withColumn("secrets", span_finder(fit(docs))(F.col("text")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret in text replaced by `[REDACTED]`; other texts and columns stay as they are.

    n_chars, where there is such a column, follows the text.
    """
    new = unused_name(docs, "_new")
    out = docs.withColumn(new, redactor(fit(docs))(F.col("text")))
    hit = F.col(new).isNotNull()
    out = out.withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(new)


def written(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of that kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
