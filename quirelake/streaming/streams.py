"""Structured Streaming jobs: a resumable queue, answers kept for a time, identifiers used once, running counters.

Each takes a folder for its checkpoint and for what it writes; give folders on storage that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirelake.operators.durable import shared_folder


def workspace(spark: SparkSession) -> str:
    """A new folder in the folder that the driver and the executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The event files of a folder (or one file) as a stream, a capped number a batch."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern the source takes a single file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def drain(stream: DataFrame, folder: str) -> None:
    """Append what is new since the folder's checkpoint to its output, in as many batches as there are, and stop."""
    with keep_state_in_rocksdb(stream.sparkSession):
        (
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start().awaitTermination()
        )


def worked_queue(stream: DataFrame) -> DataFrame:
    """The queue's rows as done work; a run that resumes from its checkpoint repeats none."""
    return stream.select("event_id", "user_id", F.when(F.col("value") < 1, "failed").otherwise("completed").alias("status"))


class _Answers(StatefulProcessor):
    """One key's requests: `saved`, the time of its last answer, and `waiting`, requests that the watermark has not
    passed yet, both in microseconds. Timers bring the key back once the watermark reaches its first waiting request, or
    once its answer is too old to serve any."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "at long")
        self.waiting = handle.getValueState("waiting", "times binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.concatenate([self._waiting(), *(frame["at"].to_numpy(np.int64) for frame in rows)])
        yield from self._served(key, times, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._served(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _waiting(self) -> np.ndarray:
        held = self.waiting.get()
        return np.frombuffer(held[0], np.int64) if held else np.zeros(0, np.int64)

    def _served(self, key: tuple, times: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        times = np.sort(times)
        n = int(np.searchsorted(times, (watermark + 1) * 1000))
        ready, later = times[:n], times[n:]
        held = self.saved.get()
        saved = held[0] if held else None
        answers, at = [], 0 if saved is None else int(np.searchsorted(ready, saved + self.life, "right"))
        while at < n:  # from one answer to the first request that it does not serve
            saved = int(ready[at])
            answers.append(saved)
            at = int(np.searchsorted(ready, saved + self.life, "right"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(later):
            self.waiting.update((later.tobytes(),))
            self.handle.registerTimer(int(later[0]) // 1000)
        else:
            self.waiting.clear()
        if saved is not None and saved + self.life < watermark * 1000 and not len(later):
            self.saved.clear()
        elif saved is not None:
            self.saved.update((saved,))
            if not len(later):
                self.handle.registerTimer((saved + self.life) // 1000 + 1)
        if answers:
            yield pd.DataFrame({"key": [key[0]] * len(answers), "at": answers})


def answered_once(stream: DataFrame, hours: int = 24, late: str = "0 seconds") -> DataFrame:
    """(key, ts): the requests (key, ts) that are answered anew. One within `hours` of the last answer of its key is
    served from it and does not renew it.

    Requests are judged in the order of their times: each waits until the watermark, `late` behind the newest request,
    has passed it, to the millisecond; later ones are dropped. The state of a key is one answer and what waits, and goes
    once the answer is too old for any request that may still come. Needs the RocksDB state store (keep_state_in_rocksdb).
    """
    kinds = dict(stream.dtypes)
    timed = stream.select("key", F.col("ts").cast("timestamp").alias("_at")).withWatermark("_at", late)
    rows = timed.withColumn("at", F.unix_micros("_at"))
    answers = rows.groupBy("key").transformWithStateInPandas(_Answers(hours * 3_600_000_000), f"key {kinds['key']}, at long", "append", "eventtime")
    return answers.select("key", F.timestamp_micros("at").cast(kinds["ts"]).alias("ts"))


class _FirstUse(StatefulProcessor):
    """The first use of one key; the state is a flag."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            row = min(zip(frame["at"].tolist(), frame["event_id"].tolist(), strict=True))
            best = row if best is None else min(best, row)
        if best is not None and not self.used.exists():
            self.used.update((True,))
            yield pd.DataFrame({"a": [key[0]], "b": [key[1]], "at": [best[0]], "event_id": [best[1]]})

    def close(self) -> None:
        pass


def unused(stream: DataFrame, review: str, identifier: str) -> DataFrame:
    """(review, identifier, ts, event_id): the first use of each identifier in a review, over all batches.

    State is one flag a (review, identifier), so that a large review spreads over all tasks; only keys met in a batch
    are read. Needs the RocksDB state store (keep_state_in_rocksdb).
    """
    kinds = dict(stream.dtypes)
    rows = stream.select(review, identifier, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    schema = f"a {kinds[review]}, b {kinds[identifier]}, at long, event_id long"
    first = rows.groupBy(review, identifier).transformWithStateInPandas(_FirstUse(), schema, "append", "none")
    return first.select(F.col("a").alias(review), F.col("b").alias(identifier), F.timestamp_micros("at").alias("ts"), "event_id")


@contextmanager
def keep_state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB, on the executors' disks with its changes in the checkpoint."""
    name, kept = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kept)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counters(stream: DataFrame, group: str) -> DataFrame:
    """Running attempts and successes of each group."""
    return stream.groupBy(group).agg(F.count("*").alias("attempts"), F.count_if(F.col("value") >= 1).alias("successes"))


def drain_counters(stream: DataFrame, folder: str) -> DataFrame:
    """Bring running counters up to date and give their current rows. Each batch writes the whole state to a folder of
    its own, named by the batch, so that a batch that runs again writes the same folder again."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{batch:012d}")

    run = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/batch-{run.lastProgress['batchId']:012d}")
