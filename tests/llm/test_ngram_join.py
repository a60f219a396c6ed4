import random
import re
from itertools import combinations

import pytest
from helpers import ODD, given, table
from pyspark.sql import functions as F

from quirelake.llm import ngram_join as nj

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {p for ids in index.values() for p in combinations(sorted(ids), 2)}
    for a, b in sorted(pairs):
        common = len(sets[a] & sets[b])
        if 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_given_documents(spark, k, num):
    docs = given(spark)
    assert got(nj.similar_groups(docs, k, num)) == brute([(r.doc_id, r.text) for r in docs.collect()], k, num)


def random_rows(seed, hot):
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(30))
    rows, origin = [], [" ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    for i in range(260):
        words = rng.choice(origin).split()
        if hot and i % 3 == 0:
            words = (origin[0] + " x").split() + [f"h{j}" for j in range(60)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
        if rng.random() < 0.3:
            words += line.split()
        rows.append((i * 7 % 1009, " ".join(words).title() if rng.random() < 0.1 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 90), (2, 5, 80)])
def test_against_all_pairs_with_a_hot_group(spark, seed, k, num, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", 6)
    rows = random_rows(seed, hot=True)
    assert got(nj.similar_groups(table(spark, rows), k, num)) == brute(rows, k, num)


def test_odd_rows_and_empty_table(spark):
    rows = got(nj.similar_groups(table(spark, [r for r in ODD if r[0] is not None]), 3, 90))
    assert (0, 0, 0) in rows and (1, 0, 1) in rows and (2, 0, 2) in rows and rows.count((6, 4, 5)) == 2
    assert nj.similar_groups(table(spark, ODD), 3, 90).count() == len(ODD)
    assert nj.similar_groups(table(spark, []), 3, 90).count() == 0


def test_one_of_a_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = table(spark, [(5, text), (3, text + " end"), (9, "quite another text of six words"), (None, None)])
    left = nj.drop_similar(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.collect()) == [(False, 3), (False, 9), (True, None)]


def test_a_row_with_the_id_of_a_near_copy_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = table(spark, [(5, text), (3, text + " end"), (5, "quite another text of seven short words"), (8, text + " x"), (8, "one more text without any like it")])
    left = nj.drop_similar(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text[:5]) for r in left.collect()) == [(3, "w0 w1"), (5, "quite"), (8, "one m")]
    two = nj.drop_similar(table(spark, [(2, text), (2, "quite another text"), (9, text + " end")]))
    assert sorted((r.doc_id, r.text[:5]) for r in two.collect()) == [(2, "quite"), (2, "w0 w1")]
    same = nj.drop_similar(table(spark, [(5, text), (5, text), (7, text + " x"), (4, " "), (4, " "), (None, text), (None, text)]))
    assert sorted((str(r.doc_id), r.text[:5]) for r in same.collect()) == [("4", " "), ("4", " "), ("5", "w0 w1"), ("None", "w0 w1"), ("None", "w0 w1")]


def test_sketch_words_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    b = np.unique(np.r_[a[20:], rng.integers(0, 1 << 63, 15).astype(np.uint64)])
    differ = (nj.sketch(a, 4, 90) != nj.sketch(b, 4, 90)).sum()
    assert 0 < differ <= len(np.setxor1d(a, b))
    bands = nj.Bands(80, 100, 10**6)
    for n in [1, 2, 5, 9, 10, 100, 1000, 12345]:
        for m in {n, max(1, n * 8 // 10 + (n * 8 % 10 > 0)), n - n // 9}:
            if m * 100 >= n * 80:
                assert set(bands.of(n)) & set(bands.of(m)), (n, m)
        assert len(bands.of(n)) <= 2


def test_column_names_with_dots(spark):
    docs = table(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (2, "other words that are here now")]).withColumn("a.b", F.lit(1))
    out = nj.drop_similar(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_sketches_of_a_large_batch_are_made_in_parts():
    """What a worker holds beside its batch does not grow with the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for run in (nj.sketched(Docs(), 5, 80, 100), nj._shingles(Docs(), 5)):
        tracemalloc.start()
        rows = sum(len(out.column("doc_id").unique()) for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(texts) and peak < 40e6, peak
