import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, given, table
from pyspark.sql import functions as F

from quirelake.llm import periodic, queries


def plain_runs(words, least=6, times=4):
    """Every run by trying every period: (start, length, period) by start, then period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            smallest = all(any(stretch[t] != stretch[t + p] for t in range(len(stretch) - p)) for p in range(1, q) if q % p == 0)
            if smallest and len(stretch) >= max(least, times * q):
                out.append((start, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {t for s, n, q in runs for t in range(s + q, s + n)}
    return " ".join(w for t, w in enumerate(words) if t not in gone)


def split(text):
    return (text or "").encode().split()


def answers(docs, **more):
    return {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs)), r.n_words) for r in periodic.find_runs(docs, **more).collect()}


def test_runs_against_every_period():
    rng = random.Random(5)
    for turn in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 12))]
            for _ in range(rng.randint(0, 4)):
                words += [rng.choice("abcd") for _ in range(rng.randint(1, 7))] * rng.randint(1, 7) + [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
            texts.append(" ".join(words))
        h, at = periodic.hashed_words(pa.array(texts))
        want = [(int(low) + s, n, q) for low, t in zip(at, texts, strict=False) for s, n, q in plain_runs(t.split())]
        assert [tuple(r) for r in periodic.runs_of(h, at).tolist()] == want, (turn, texts)


def test_odd_texts(spark):
    rows = [*ODD, (20, "x " * 6), (21, "x " * 5), (22, "a b a b a b a b"), (23, "\n a\tb\x0ba b\x0ca b  a b c"), (24, "z " + "a a b a a b a a b a a b " * 9 + "z"), (24, "x " * 6)]
    want = set()
    for i, text in rows:
        words = split(text)
        runs = plain_runs(words)
        want.add((i, collapsed([w.decode() for w in words], runs), tuple(runs), len(words)))
    assert answers(table(spark, rows).withColumn("runs", F.lit(1))) == want
    assert periodic.find_runs(table(spark, [])).count() == 0


def test_one_long_text(spark):
    words = ([f"w{i}" for i in range(5000)] * 5)[:23000] + ["tail"] * 40000 + [f"v{i}" for i in range(60000)]
    (row,) = periodic.find_runs(table(spark, [(1, " ".join(words))])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 23000, 5000), (23000, 40000, 1)][-len(row.runs) :]
    assert len(row.runs) == 2 and row.collapsed == " ".join(words[:5000] + ["tail"] + words[63000:])


def test_slices_do_not_matter(spark, monkeypatch):
    docs = given(spark).limit(60).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 5))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    whole = periodic._worked([i for i, _ in rows], pa.array([t for _, t in rows]), None, 6, 4)
    monkeypatch.setattr(periodic, "_COPY", 7)
    assert [c.to_pylist() for c in periodic._worked([i for i, _ in rows], pa.array([t for _, t in rows]), None, 6, 4)] == [c.to_pylist() for c in whole]
    assert [b - a for a, b in periodic.row_slices(pa.array(["x" * 600, None, "y" * 600, "z" * 5000, ""]), 1000)] == [2, 1, 1, 1]


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(3, np.uint64), np.array([0, 3]), times=3)


def test_query_against_every_period(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    hit = 0
    for r in given(spark).collect():
        words = [w.decode() for w in split(r.text)]
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 1500 or h % 10 == 0 and n < 4000 else None
        if runs is None:
            continue
        row = got[r.doc_id]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        hit += len(runs)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert hit > 5
