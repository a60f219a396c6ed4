"""Streams against folds in plain Python, over several batches with a restart between them, and the store join beside them."""

import random
from datetime import datetime, timedelta

import pytest

from quirelake.operators import matching
from quirelake.streaming import streams

START = datetime(2024, 1, 1)


def fold(rows, hours=24):
    """(key, ts): the answers, with each request served by the last one of its key."""
    saved, out, serves = {}, [], []
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in saved or ts > saved[key] + timedelta(hours=hours):
            saved[key] = ts
            out.append((key, ts))
        serves.append((key, ts, i, saved[key]))
    return sorted(out, key=str), sorted(serves, key=str)


def requests(n, keys, days, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), START + timedelta(seconds=rng.randint(0, days * 86400) // 600 * 600), i) for i in range(n)]
    return rows + [(k, t + timedelta(hours=24), n + i) for i, (k, t, _) in enumerate(rows[:20])]  # exactly the limit


def write(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in-{n}")


def batches(spark, folder, parts, schema, job, kind="out"):
    """Give job one file after the other, each in a run of its own that resumes from the checkpoint."""
    got = []
    (folder / "all").mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/all")
        streams.drain(job(streams.events(spark, f"{folder}/all")), str(folder / "run"))
    got = spark.read.parquet(str(folder / "run" / "out")).collect()
    return got


def test_identifiers_are_used_once_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.choice("abcdefgh"), START + timedelta(hours=rng.randint(0, 90)), i) for i in range(300)]
    parts = [rows[:40], rows[40:60], rows[60:]]
    got = batches(spark, tmp_path, parts, "review long, identifier string, ts timestamp, event_id long", lambda s: streams.unused(s, "review", "identifier"))
    want = {}
    for part in parts:
        for r, i, ts, e in sorted(part, key=lambda x: (x[2], x[3])):
            want.setdefault((r, i), (ts, e))
    assert {(r.review, r.identifier): (r.ts, r.event_id) for r in got} == want and len(got) == len(want)


def test_answers_hold_a_day_over_batches(spark, tmp_path):
    rows = sorted(requests(400, ["a", "b", None, "c"], 9, 3), key=lambda r: r[1])
    # the batches overlap by less than the two hours that the stream waits
    cut = [START + timedelta(days=d) for d in (3, 5)]
    rng = random.Random(4)
    parts = [[], [], []]
    for r in rows:
        at = sum(r[1] >= c + rng.choice([-1, 1]) * timedelta(minutes=50) for c in cut)
        parts[at].append(r)
    for p in parts:
        rng.shuffle(p)
    parts.append([("end", START + timedelta(days=400), 10**6)])
    job = lambda s: streams.answered_once(s.select("key", "ts"), late="2 hours")
    got = batches(spark, tmp_path, parts, "key string, ts timestamp, id long", job)
    want, _ = fold([r for p in parts[:3] for r in p])
    assert sorted(((r.key, r.ts) for r in got if r.key != "end"), key=str) == want


@pytest.mark.parametrize(("n", "days", "width"), [(300, 12, 3600), (300, 2, 100_000), (60, 90, 7 * 86400), (1, 1, 60), (2000, 30, 600)])
def test_store_join_against_a_fold(spark, n, days, width):
    rows = requests(n, ["a", "b", None], days, n + days)
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long").unionByName(spark.createDataFrame([("a", None, -1)], "key string, ts timestamp, id long"))
    got = matching.served_from_store(df, width=width).collect()
    assert [(r.key, r.saved_at) for r in got if r.id == -1] == [("a", None)]
    assert sorted(((r.key, r.ts, r.id, r.saved_at) for r in got if r.id >= 0), key=str) == fold(rows)[1]


def test_store_join_of_one_hot_gapless_key(spark):
    """A million requests of one key, one a minute and more: in no task of the plan may they all meet."""
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select(F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 61_000_000 + F.col("id") % 7).alias("ts"), "id")
    out = matching.served_from_store(df)
    n, answers, odd = out.agg(F.count("*"), F.countDistinct("saved_at"), F.count_if((F.col("saved_at") > F.col("ts")) | (F.col("ts") > F.col("saved_at") + F.expr("interval 24 hours")))).first()
    times = [i * 61_000_000 + i % 7 for i in range(1_000_000)]
    saved, want = None, 0
    for t in times:
        if saved is None or t > saved + 86_400_000_000:
            saved, want = t, want + 1
    assert (n, answers, odd) == (1_000_000, want, 0)


def test_store_join_of_nothing(spark):
    assert matching.served_from_store(spark.createDataFrame([], "key string, ts timestamp, id long")).count() == 0
