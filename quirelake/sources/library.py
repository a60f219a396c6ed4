"""A stored library of earlier answers: saved by content address, replaced bucket by bucket, looked up by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.durable import settle
from quirelake.sources.sinks import library, library_key

#: What is kept of an answer besides its key.
FIELDS = "source string, source_url string, identifier string, licence string, author string, payload binary"
BUCKETS = 64
# The sources that may be kept, what a picture starts with, and its bytes, at least one more than the first.
SOURCES = ("pexels", "pixabay", "openverse")
JPEG, LEAST, MOST = b"\xff\xd8", 1024, 22 * 1024 * 1024


class Library:
    """Answers in folder, a row a key, dealt into buckets by key.

    A save writes the buckets that it touches under a new number, and last a manifest that tells for each bucket the number
    to read. Readers take the newest manifest that is complete: a save is seen whole or not at all, also if it
    breaks off. There may be one writer at a time. Rows of buckets that nothing touches are neither read nor written.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._fs_path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the saves that have written what is of this kind."""
        top = self._fs_path(f"{self.folder}/{kind}")
        names = [s.getPath().getName() for s in self._files.listStatus(top)] if self._files.exists(top) else []
        return sorted(int(n[2:]) for n in names if n.startswith("n-"))

    def _manifest(self) -> dict[int, int]:
        """bucket: number, of the newest complete manifest; a row a bucket at most."""
        for n in reversed(self._numbers("manifest")):
            at = f"{self.folder}/manifest/n-{n:012d}"
            if self._files.exists(self._fs_path(f"{at}/_SUCCESS")):
                return {r["bucket"]: r["number"] for r in self.spark.read.schema("bucket int, number long").parquet(at).collect()}
        return {}

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        schema = f"key string, {FIELDS}"
        paths = [f"{self.folder}/data/n-{n:012d}/bucket={b}" for b, n in manifest.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """(key, FIELDS): everything that is kept."""
        return self._read(self._manifest())

    def save(self, rows: DataFrame, order: str) -> None:
        """Keep rows (query, subject, orientation, FIELDS): of the same search the last by `order`, and over what was
        kept for it before. Rows of other sources and payloads that are no JPEG are passed over."""
        good = rows.where(F.substring("payload", 1, 2) == F.lit(JPEG))
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        names = ["key", *self.spark.createDataFrame([], FIELDS).columns]
        new = settle(library(good, list(SOURCES), order).select(*names).withColumn("bucket", bucket))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        before = self._manifest()
        old = self._read({b: n for b, n in before.items() if b in touched}).withColumn("bucket", bucket)
        kept = new.unionByName(old.join(new.select("key"), "key", "left_anti"))
        number = max([0, *self._numbers("data"), *self._numbers("manifest")]) + 1
        kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/n-{number:012d}")
        now = before | {b: number for b in touched}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, number long").coalesce(1).write.parquet(f"{self.folder}/manifest/n-{number:012d}")

    def find(self, requests: DataFrame) -> DataFrame:
        """requests (query, subject, orientation) with the FIELDS of the answer kept for them; null where none is, or
        where it is of a source that may not be kept, no JPEG, too small or too large."""
        size = F.octet_length("payload")
        sound = self.rows().where(F.col("source").isin(*SOURCES) & (size > LEAST) & (size <= MOST) & (F.substring("payload", 1, 2) == F.lit(JPEG)))
        asked = requests.withColumn("key", library_key(F.col("query"), F.col("subject"), F.col("orientation")))
        return asked.join(sound, "key", "left").drop("key")

    def tidy(self) -> None:
        """Delete what no reader of the newest manifest needs."""
        needed, manifests = set(self._manifest().values()), self._numbers("manifest")
        for n in self._numbers("data"):
            if n not in needed and n <= max(manifests, default=0):
                self._files.delete(self._fs_path(f"{self.folder}/data/n-{n:012d}"), True)
        for n in manifests[:-1]:
            self._files.delete(self._fs_path(f"{self.folder}/manifest/n-{n:012d}"), True)
