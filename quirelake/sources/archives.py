"""Archives: zips made from a table of files, and a source that lists the members of zips of any size."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MEMBERS = "path string, pos int, member string, bytes long, is_link boolean, error string"


def members(path: str, archive) -> list[tuple]:
    """A row of MEMBERS for each member of a zip given as a file that can be sought, or one with its error. Only the
    directory at the archive's end is read."""
    try:
        with zipfile.ZipFile(archive) as z:
            return [(path, pos, i.filename, i.file_size, (i.external_attr >> 16) & 0o170000 == 0o120000, None) for pos, i in enumerate(z.infolist())]
    except (zipfile.BadZipFile, TypeError, ValueError, AttributeError):  # no archive, no content, a place sought before the start
        return [(path, None, None, None, None, "not a readable archive")]


def member_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "pos", "member", "bytes", "is_link", "error"])


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".zip").lower()
        self.at_once = int(options.get("files", 32))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[_Files]:
        """Some files each; only names come to the driver."""
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix))
        return [_Files(paths[i : i + self.at_once]) for i in range(0, len(paths), self.at_once)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_file(path) as archive:
                yield member_batch(members(path, archive))


class ZipListing(DataSource):
    """Format `zip_listing`: the members of all zips below `path` (local, s3://, gs://, hdfs:// …), a row each.

    Options: `suffix` (.zip) of the files taken, `files` (32) of one task. Of an archive the directory at its end is read and nothing
    else, so that its size does not matter. Stores that only the engine reaches are read by scan.archive_members over `binaryFile`.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_listing"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ListingReader(self.options)


def listed(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of all archives below folder, as rows of MEMBERS."""
    spark.dataSource.register(ZipListing)
    return spark.read.format("zip_listing").options(**options).load(folder)


def zipped(files: DataFrame) -> DataFrame:
    """(path, content): a zip for each batch_id whose members hold their own names; a batch is a few files."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, name in pdf.sort_values("file_id")[["file_id", "filename"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(f"{i}/{name}"), name)
        return pd.DataFrame({"path": [str(pdf["batch_id"].iloc[0])], "content": [out.getvalue()]})

    return files.select("batch_id", "file_id", "filename").groupBy("batch_id").applyInPandas(pack, "path string, content binary")
