"""Cutting lineage so that a lost executor costs no result, and freeing what has been superseded."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the context's own checkpoint folder.

    A folder of this machine is set only where neither names one and Spark runs on this machine alone.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quirelake-checkpoint-"))
    return named or context.getCheckpointDir()


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """The shuffles of plans made and run in here go with their last task."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the folder the cluster names."""
    shared_folder(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint()


class Stored:
    """A table written in the shared folder: rows reads it, free() deletes it once nothing needs it any more."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark).rstrip('/')}/quirelake-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        with _tidy(spark):
            df.select("*").write.parquet(self.path)
        self._files.deleteOnExit(self._path)
        self.rows = spark.read.schema(df.schema).parquet(self.path)

    def free(self) -> None:
        self._files.delete(self._path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one that is deleted at the end; it is not there yet."""
    path = f"{shared_folder(spark).rstrip('/')}/quirelake-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(folder)
    try:
        yield path
    finally:
        files.delete(folder, True)
