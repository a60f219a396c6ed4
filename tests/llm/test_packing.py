import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from helpers import ODD, given, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelake.llm import packing


def check(docs, pieces, window=1024):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)  # doc_id -> the id lists of its rows
    for r in docs.collect():
        want[r.doc_id].append(coder.encode(r.text or "", add_special_tokens=False).ids + [0])
    rows = [r.asDict() for r in pieces.collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for doc_id, parts in by_doc.items():
        assert sum(p["length"] for p in parts) == sum(map(len, want[doc_id]))
        if len(want[doc_id]) == 1:
            ids, at = want[doc_id][0], 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
    short = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window and at & (at - 1) == 0
        short += at < window
    return rows, short


def test_given_documents(spark):
    check(given(spark), packing.pack(given(spark)))


def test_odd_documents_and_small_shards(spark):
    docs = table(spark, ODD)
    check(docs, packing.pack(docs))
    check(docs, packing.pack(docs, shard=3000))
    assert packing.pack(table(spark, [])).count() == 0


def test_the_plain_tokenizer_gives_the_ids_of_the_full_one():
    coder, full = packing.Encoder("byte_bpe_50k"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", " ", "a b", " a", "a ", "a  b", "a \n b", "x\n y", "it's  'll we've 12 34,5", "é ñ  z", "\x1c a", "a \x85b", "<|endoftext|> a", "tab\tb c\n\nd e"]:
        assert np.frombuffer(coder.ids(text), np.uint16).tolist() == full.encode(text, add_special_tokens=False).ids, text


def test_neighbours_come_first():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1, 40000, 300).astype(np.uint16) for _ in range(5)]
    docs = [np.r_[topics[i % 5][:200], rng.integers(1, 40000, 20).astype(np.uint16)] for i in range(40)]
    order = packing.order_of(docs, 1024)
    assert sorted(order) == list(range(40))
    assert sum(a % 5 == b % 5 for a, b in zip(order, order[1:], strict=False)) > 25


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(2)
    docs = [np.r_[rng.integers(1, 9, rng.integers(0, 40)), 0].astype(np.uint16) for _ in range(700)]
    docs += [np.array([500 + i // 2, 0], np.uint16) for i in range(10)]  # one bigram each
    bags = [Counter(zip(d[:-1].tolist(), d[1:].tolist(), strict=True)) for d in docs]
    df = Counter(t for b in bags for t in b)
    mean = np.mean([b.total() for b in bags])
    unused = np.arange(len(docs)) % 3 > 0
    unused[:300] = False
    unused[700:] = True
    index = packing.Index(docs)
    for seed in [*range(0, 60), *range(700, 710)]:
        unused[seed] = False
        want = {}
        for j in np.flatnonzero(unused).tolist():
            size = packing.K1 * (1 - packing.B + packing.B * bags[j].total() / mean)
            score = sum(np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * bags[j][t] * (packing.K1 + 1) / (bags[j][t] + size) for t in bags[seed] if t in bags[j])
            if score > 0:
                want[j] = score
        near = list(index.neighbours(seed, unused))
        best = sorted(want.values(), reverse=True)
        assert np.allclose([want[j] for j in near], best) and len(near) == len(best), seed
        unused[seed] = seed >= 700
    unused[709] = False
    assert list(index.neighbours(709, unused)) == [708]


def test_a_seed_takes_its_best_neighbours_until_its_window_is_full():
    rng = np.random.default_rng(5)
    docs = [np.r_[rng.integers(1, 9, rng.integers(0, 60)), 0].astype(np.uint16) for _ in range(200)]
    index, unused, want, room = packing.Index(docs), np.ones(len(docs), bool), [], 0
    for seed in range(len(docs)):
        if unused[seed]:
            take = [seed]
            unused[seed] = False
            room = (room - len(docs[seed])) % 64
            ranked = list(index.neighbours(seed, unused))
            while room and ranked:
                n = ranked.pop(0)
                take.append(n)
                room = 0 if len(docs[n]) == room else room - len(docs[n])
                if room < 0:
                    break
            room %= 64
            unused[take] = False
            want += take
    assert packing.order_of(docs, 64) == want and sorted(want) == list(range(200))


def test_shards_hold_what_they_may(spark):
    """Long, short, empty and equal texts: no shard is over its bound, and few are much below it."""
    docs = given(spark).select("doc_id", "text").unionByName(table(spark, [(10_000 + i, "same words again " * 40) for i in range(300)] + [(20_000 + i, "") for i in range(2000)]).select("doc_id", "text"))
    ready = packing.settle(packing.tokenised(docs, "byte_bpe_50k"))
    met, n = packing.dealt_out(ready, 40_000)
    sizes = {r.shard: r.w for r in met.groupBy("shard").agg(F.sum(F.col("n_ids") + packing.ROW).alias("w")).collect()}
    whole = ready.agg(F.sum(F.col("n_ids") + packing.ROW)).first()[0]
    largest = ready.agg(F.max("n_ids")).first()[0]
    assert n == max(sizes) + 1 and max(sizes.values()) <= 1.2 * 40_000 + largest and n <= 3 * whole / 40_000
    check(docs, packing.pack(docs, shard=40_000))


def test_many_empty_texts_in_one_shard():
    import time

    began = time.time()
    assert packing.order_of([np.zeros(1, np.uint16)] * 200_000) == list(range(200_000))
    assert time.time() - began < 20


def test_texts_without_double_blanks_take_the_quick_pattern():
    """all_ids gives the full tokenizer's ids, and where no blanks stand side by side in less time than with the pattern that looks ahead."""
    import time

    import pyarrow as pa

    coder, full = packing.Encoder("byte_bpe_50k"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, " ", "  ", "a b ", " a b", "a  b", "a \n b", "a\u00a0\u3000b", "a\u2003b it's 'llama'", "x\ny z", "\x1c \x1d a", "a\u200b b", "\u1680\u2028 a", "ab <|endoftext|>  c", "'re ' s 12 a1!? ..é"]
    want = [full.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint16).tolist() for x in coder.all_ids(pa.array(texts))] == want
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 9, 3000)]
    long = pa.array([" ".join(rng.choice(words, 2000)) for _ in range(60)])

    def seconds(f):
        began = time.process_time()
        assert f()
        return time.process_time() - began

    plain = min(seconds(lambda: list(coder.all_ids(long))) for _ in range(5))
    ahead = min(seconds(lambda: [coder.ids(t) for t in long.to_pylist()]) for _ in range(5))
    assert plain < 0.9 * ahead


def test_an_index_holds_few_arrays_of_its_shards_size():
    import tracemalloc

    rng = np.random.default_rng(5)
    words = rng.integers(0, 300, 1_000_000).astype(np.uint16)
    ids = [np.ascontiguousarray(x) for x in np.array_split(words, 1000)]
    tracemalloc.start()
    packing.Index(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48.5 * len(words), peak / len(words)


def test_shards_are_dealt_without_python_workers(spark):
    import contextlib
    import io

    plan = io.StringIO()
    dealt, shards = packing.dealt_out(spark.range(100).selectExpr("id AS doc_id", "10L AS n_ids", "id * 1000000007 AS signature"), 1000)
    with contextlib.redirect_stdout(plan):
        dealt.explain()
    assert shards > 1 and "LocalTableScan" in plan.getvalue() and "ExistingRDD" not in plan.getvalue()
    empty, shards = packing.dealt_out(spark.range(0).selectExpr("id AS doc_id", "10L AS n_ids", "id AS signature"), 1000)
    assert shards == 0 and empty.count() == 0


def test_encoders_are_freed_once_all_is_tokenised(monkeypatch):
    import pyarrow as pa

    class Dealt:
        def repartitionById(self, *_):  # noqa: N802
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    monkeypatch.setattr(packing, "tokenised", lambda *_: None)
    monkeypatch.setattr(packing, "settle", lambda df: df)
    monkeypatch.setattr(packing, "dealt_out", lambda *_: (Dealt(), 1))
    run = packing.pack(None)
    (ids,) = packing.encoder("byte_bpe_50k").all_ids(pa.array(["some text"]))
    names = ["doc_id", "ids", "n_ids", "signature", "shard"]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([ids + b"\0\0"], pa.binary()), pa.array([3]), pa.array([1]), pa.array([0])], names=names)
    assert [r for out in run(iter([batch])) for r in out.column("doc_id").to_pylist()] and not packing._encoders
