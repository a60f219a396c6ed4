"""Texts longer than any slice or chunk that the operators work in: over a megabyte each."""

import random

import test_ngram_join as joins
import test_substring_dedup as repeats
from helpers import table
from test_packing import check
from test_secret_scan import brute as base_spans

from quirelake.llm import common, ngram_join, packing, secret_scan, substring_dedup


def long_words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_near_copies(spark):
    words = long_words(230_000, 1)
    near = [w + "x" if i % 100 == 0 else w for i, w in enumerate(words)]
    other = [w + "x" if i % 20 == 0 else w for i, w in enumerate(words)]
    rows = [(3, " ".join(words)), (1, "\n".join(near)), (2, " ".join(other)), (4, "x" * (2 * common._SLICE)), (5, "X" * (2 * common._SLICE))]
    assert len(rows[0][1].encode()) > 2 * common._SLICE
    assert joins.got(ngram_join.similar_groups(table(spark, rows), k=3, num=90)) == joins.brute(rows, 3, 90)


def test_repeated_passages(spark):
    words = long_words(150_000, 2)
    rows = [(1, " ".join(words)), (2, " ".join(long_words(40_000, 3) + words[70_000:70_400] + long_words(60_000, 4) + words[:19])), (3, " ".join(words[149_000:] + ["end"] + words[:30])), (4, "y" * (2 * common._SLICE))]
    assert repeats.got(substring_dedup.remove_repeats(table(spark, rows))) == repeats.brute(rows, 20)


def test_secrets_at_the_end(spark):
    text = " ".join(long_words(200_000, 5)) + ' password = "Zx81-correct-horse" ' + "0123456789abcdef" * 4
    rows = [(1, text), (2, "AKIA" + "A" * 2_000_000), (3, "token=" + "b" * 1_500_000)]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets if s.kind != "format"] for r in secret_scan.scan(table(spark, rows)).collect()}
    assert got == {i: base_spans(t) for i, t in rows} and len(got[1]) >= 2


def test_packing(spark):
    docs = table(spark, [(1, " ".join(long_words(200_000, 6))), (2, " ".join(long_words(90_000, 7))), (3, "short"), (4, None)])
    check(docs, packing.pack(docs, shard=50_000))
