import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, given, table

from quirelake.llm import substring_dedup as sd
from quirelake.llm.common import hashed_words


def brute(rows, k):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, out = set(), []
    for i in sorted(words):
        w, gone = words[i], set()
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone.update(range(p, p + k))
            seen.add(key)
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_given_documents(spark):
    docs = given(spark)
    assert got(sd.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 20)


@pytest.mark.parametrize("k", [20, 7])
def test_random_texts(spark, k):
    rng, rows = random.Random(k), []
    passages = [[rng.choice("abcdefgh") for _ in range(60)] for _ in range(6)]
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a = rng.randrange(30)
            words += p[a : a + rng.randrange(60)] if rng.random() < 0.7 else [rng.choice("ab") for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            words += passages[0]
        rows.append((rng.randrange(10**6), " ".join(words)))
    rows = list(dict(rows).items())
    assert got(sd.remove_repeats(table(spark, rows), k)) == brute(rows, k)


def test_odd_rows_and_empty_table(spark):
    rows = sd.remove_repeats(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0
    assert (by[8].n_words, by[8].n_removed) == (6000, 5999 - 1)
    assert sd.remove_repeats(table(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (5, t), (5, "short"), (5, None), (7, "a " + t), (7, "a " + t), (None, t)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text[:5]) for r in sd.remove_repeats(table(spark, rows)).collect())
    assert got == [("1", 40, 0, "w0 w1"), ("5", 0, 0, ""), ("5", 1, 0, "short"), ("5", 40, 40, ""), ("7", 41, 40, "a"), ("7", 41, 40, "a"), ("None", 40, 0, "w0 w1")]
    two = sd.remove_repeats(table(spark, [(5, t), (5, "x " + t)])).collect()
    assert sorted(r.n_removed for r in two) == [0, 40]


def test_pieces_hold_every_edge_once():
    words, at = hashed_words(pa.array(["a b c d e f g h i j", "x", None, "b c d e f g h a b c d e f g h"]))
    p = sd.paths(words, at, 4, 2)
    assert p.n.sum() == 7 + 12
    edges = [p.edges[f : f + n] for f, n in zip(p.first, p.n, strict=True)]
    for e in edges:
        assert len(e)
    assert len(set(np.concatenate(edges).tolist())) == 10
