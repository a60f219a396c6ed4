"""WARC archives written and read with Spark's text files, and captures put together from their records.

A record is its header lines, an empty line, its block and two line ends; written with those as line separator, rows of
text files are records. Read with the separator and the next record's version line as separator, each row is a record
again, and large plain archives are split among tasks. Payloads that hold that separator themselves are told by their
Content-Length; their files are put together anew in order, so that any payload comes back as it was.

A payload that several pages have is written once: payloads that cannot repeat are told by a filter in the scan and are
never shuffled; of the others one copy of each goes through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import Stored, bit_filter, passing, settle

VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record types that a capture is built around.
PRIMARY = ("response", "revisit", "resource", "conversion")
_END = "\r\n\r\n"
_KEY = ("payload_digest", "payload_bytes", "fold")


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a string's or binary's bytes in upper-case base32, without a prefix."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(uri: Column) -> Column:
    """The address with blanks and control characters percent-encoded, so that it fits a header line."""
    encoded = reduce(lambda u, c: F.replace(u, F.lit(chr(c)), F.lit(f"%{c:02X}")), [*range(1, 33), 127], uri)
    return F.when(uri.rlike(r"[\x01-\x20\x7f]"), encoded).otherwise(uri)


def _record_id(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\t")) for p in parts]), 256)
    pieces = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *pieces))


def _record(kind: str | Column, record_id: Column, block: Column, content: str, *headers: tuple[str, Column]) -> Column:
    """The text of a record without the two line ends after its block; headers of null are left out."""
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")),
        *[F.concat(F.lit(f"{name}: "), value) for name, value in headers], F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def _written(rows: DataFrame, date: str) -> DataFrame:
    """The records of rows (id, url, payload or null for a revisit, payload_digest, payload_bytes, record_id, refers_to)."""
    url, rid = F.col("url"), F.col("record_id")
    there = F.concat(F.lit("<"), rid, F.lit(">"))
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", _one_line(url))]
    host, path = F.regexp_extract(_one_line(url), "://([^/?#]*)", 1), F.regexp_extract(_one_line(url), "://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(_END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    again = F.col("refers_to").isNotNull()
    about = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: quirelake\r\n"))
    return rows.select(F.explode(F.array(
        _record("request", _record_id(rid, F.lit("request")), asked, "application/http; msgtype=request", *shared, ("WARC-Concurrent-To", there)),
        _record(
            F.when(again, "revisit").otherwise("response"), rid, F.concat(head, F.when(again, "").otherwise(F.col("payload"))), "application/http; msgtype=response",
            *shared, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), ("WARC-Profile", F.when(again, REVISIT)),
            ("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
        ),
        _record("metadata", _record_id(rid, F.lit("metadata")), about, "application/warc-fields", *shared, ("WARC-Concurrent-To", there)),
    )).alias("value"))


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", payload: str = "html",
    least: int = 0, date: str = "1970-01-01T00:00:00Z", codec: str = "gzip",
) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of pages into new archives in folder.

    Of rows with equal payloads of `least` bytes or more, the one with the smallest id (null last) gets the response,
    the others revisit it; of rows alike in id and payload one gets it. A null payload is empty, a null address leaves its header
    out, blanks in an address are percent-encoded. codec: any of Spark's text files ("none" for archives that can be split).
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long"), "fold": F.xxhash64("payload")})
    repeated = bit_filter(rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1"), *_KEY)
    told = passing(rows, repeated, *_KEY)
    alone = told.where("not _passes").withColumns({"record_id": _record_id(F.col("id"), F.col("url"), F.col("payload_digest")), "refers_to": F.lit(None).cast("string")})
    # rows that may repeat, without their payloads: a number each, kept in the table so that it stays the same
    some = Stored(told.where("_passes").select("id", "url", *_KEY, F.monotonically_increasing_id().alias("row")))
    known = some.rows.withColumn("record_id", _record_id(F.col("id"), F.col("url"), F.col("payload_digest"), F.col("row")))
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    first = known.where(F.col("payload_bytes") >= least).groupBy(*_KEY).agg(F.min_by(F.struct("row", "record_id"), rank).alias("first"))
    judged = known.join(first, list(_KEY), "left")
    judged = judged.withColumn("refers_to", F.when(F.col("row") != F.col("first.row"), F.col("first.record_id"))).drop("first")
    again = judged.where("refers_to is not null").withColumn("payload", F.lit(None).cast("string"))
    copies = told.where("_passes").groupBy(*_KEY).agg(F.first("payload").alias("payload"))
    once = judged.where("refers_to is null").join(copies, list(_KEY))
    kept = ["id", "url", "payload", "payload_digest", "payload_bytes", "record_id", "refers_to"]
    records = reduce(DataFrame.unionByName, [_written(part.select(*kept), date) for part in (alone, once, again)])
    records.write.option("lineSep", _END).option("compression", codec).text(folder)
    some.free()


def _header(name: str) -> Column:
    """The value of a header line of `head`, without angle brackets; null if it is not there."""
    value = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*<?([^\r\n]*?)>?[ \t]*\r?$", 1)
    return F.when(value != "", value)


def _chunks(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """What stands between the separators: value, and whether it is shorter than its Content-Length (or has none)."""
    text = spark.read.option("lineSep", f"{_END}{version}\r\n").text(folder)
    lead = F.substring(F.lit(version + "\r\n"), 1, 1000)
    text = text.withColumn("value", F.when(F.col("value").startswith(lead), F.expr(f"substring(value, {len(version) + 3})")).otherwise(F.col("value")))
    return _measured(text)


def _measured(text: DataFrame) -> DataFrame:
    parts = text.withColumn("head", F.substring_index("value", _END, 1))
    parts = parts.withColumns({"length": _header("Content-Length").try_cast("long"), "block": F.expr("substring(value, length(head) + 5)")})
    return parts.withColumn("short", F.coalesce(F.octet_length("block") < F.col("length"), F.lit(True)))


def _mended(version: str):
    sep = f"{_END}{version}\r\n".encode()

    def missing(value: bytes) -> int:
        """Bytes of the block that the record still lacks."""
        head, _, block = value.partition(_END.encode())
        for line in head.split(b"\r\n"):
            name, _, told = line.partition(b":")
            if name.strip().lower() == b"content-length" and told.strip().isdigit():
                return int(told) - len(block)
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        file, lacks = None, 0
        for batch in batches:
            out = []
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if held and (file != name or lacks <= 0):
                    out.append(sep.join(held))
                    held = []
                lacks = lacks - len(sep) - len(value) if held else missing(value)
                held.append(value)
                file = name
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([sep.join(held)], pa.binary())], names=["value"])

    return run


def _whole_chunks(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """One row a record, also where payloads hold the separator: those files' pieces are joined in their order, each
    file in one task that holds one record at a time."""
    chunks = _chunks(spark, folder, version)
    placed = chunks.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    torn = settle(placed.where("short").select("file").distinct())
    if torn.isEmpty():
        return chunks
    pieces = placed.join(torn, "file", "left_semi").select("file", "start", "nth", F.col("value").cast("binary").alias("value"))
    dealt = pieces.repartition("file").sortWithinPartitions("file", "start", "nth").select("file", "value")
    mended = dealt.mapInArrow(_mended(version), "value binary").select(F.col("value").cast("string").alias("value"))
    return placed.join(torn, "file", "left_anti").select(*chunks.columns).unionByName(_measured(mended))


def read_records(spark: SparkSession, folder: str, version: str = VERSION) -> DataFrame:
    """One row a record: record_id, type, date, target_uri, concurrent_to (array), refers_to, payload_digest (as its header
    tells it), content_type, http (head of an HTTP message, else null), payload (string of the bytes after it, or of the
    whole block), payload_bytes, payload_sha1 (base32, of the payload read), broken (the block is shorter or longer than
    its header tells).

    An empty folder gives no rows. Archives may be split, compressed, and of any writer that uses this version.
    """
    rows = _whole_chunks(spark, folder, version)
    # the last record of a file keeps the line ends that follow it
    extra = F.octet_length("block") - F.col("length")
    rows = rows.withColumn("block", F.when((extra == 4) & F.col("block").endswith(_END), F.expr("substring(block, 1, length(block) - 4)")).otherwise(F.col("block")))
    is_http = F.coalesce(_header("Content-Type").startswith("application/http"), F.lit(False))
    rows = rows.withColumn("http", F.when(is_http, F.substring_index("block", _END, 1)))
    rows = rows.withColumn("payload", F.when(is_http, F.expr("substring(block, length(http) + 5)")).otherwise(F.col("block")))
    linked = F.transform(F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*<?([^\r\n>]*)>?"), F.lit(1)), lambda c: F.trim(c))
    return rows.select(
        _header("WARC-Record-ID").alias("record_id"), _header("WARC-Type").alias("type"), _header("WARC-Date").alias("date"), _header("WARC-Target-URI").alias("target_uri"),
        linked.alias("concurrent_to"), _header("WARC-Refers-To").alias("refers_to"), _header("WARC-Payload-Digest").alias("payload_digest"), _header("Content-Type").alias("content_type"),
        "http", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_sha1"),
        F.coalesce(F.octet_length("block") != F.col("length"), F.lit(True)).alias("broken"),
    )


def _owners(records: DataFrame) -> DataFrame:
    """(record_id, owner) of the records that are not primary: the smallest primary record that concurrent-to identifiers
    lead to, whichever of the two names the other, over as few links as possible."""
    ends = settle(records.select("record_id", F.col("type").isin(*PRIMARY).alias("primary"), "concurrent_to"))
    named = ends.select("record_id", "primary", F.explode("concurrent_to").alias("other"))
    primary = ends.where("primary").select(F.col("record_id").alias("owner"))
    forward = named.where("not primary").join(primary, F.col("other") == F.col("owner")).select("record_id", "owner")
    backward = named.where("primary").select(F.col("other").alias("record_id"), F.col("record_id").alias("owner"))
    side = ends.where("not primary").select("record_id").distinct()
    owners = settle(forward.unionByName(backward.join(side, "record_id", "left_semi")).groupBy("record_id").agg(F.min("owner").alias("owner")))
    while True:
        free = settle(side.join(owners, "record_id", "left_anti"))
        if free.isEmpty():
            return owners
        links = named.select("record_id", "other").unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
        met = links.join(free, "record_id", "left_semi").join(owners.withColumnRenamed("record_id", "other"), "other")
        more = settle(met.groupBy("record_id").agg(F.min("owner").alias("owner")))
        if more.isEmpty():
            # nothing leads to a primary record: what names the same record stands together
            loose = free.join(named, "record_id", "left").groupBy("record_id").agg(F.min(F.coalesce("other", "record_id")).alias("owner"))
            return owners.unionByName(loose)
        owners = settle(owners.unionByName(more))


def captures(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row a capture: capture_id, date, target_uri, response (struct; null where there is none), requests and
    metadata (arrays of structs, by record id).

    A capture is a primary record (response, revisit, resource, conversion) with the records tied to it by
    WARC-Concurrent-To. Records that lead to no primary record make captures without one. With payload false the
    responses' payloads are left out, so that only their sizes and digests are shuffled. A capture's own records stand in
    one row, so its size is theirs.
    """
    whole = ["record_id", "type", "date", "target_uri", "refers_to", "payload_digest", "http", "payload_bytes", "payload_sha1", "broken"]
    sides = records.where(~F.col("type").isin(*PRIMARY)).join(_owners(records), "record_id")
    each = F.struct("record_id", "type", "http", "payload")
    sides = sides.groupBy("owner").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", each))).alias("requests"), F.array_sort(F.collect_list(F.when(F.col("type") != "request", each))).alias("metadata"),
        F.min("date").alias("side_date"), F.min("target_uri").alias("side_uri"),
    )
    main = records.where(F.col("type").isin(*PRIMARY)).select(F.struct(*whole, *(["payload"] if payload else [])).alias("response"))
    both = main.join(sides, F.col("response.record_id") == F.col("owner"), "full")
    none = F.array().cast("array<struct<record_id: string, type: string, http: string, payload: string>>")
    return both.select(
        F.coalesce("response.record_id", "owner").alias("capture_id"), F.coalesce("response.date", "side_date").alias("date"), F.coalesce("response.target_uri", "side_uri").alias("target_uri"),
        "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"),
    )


def noted(metadata: Column, name: str) -> Column:
    """A field of a capture's metadata records (`name: value` lines); null if none has it."""
    values = F.transform(metadata, lambda m: F.regexp_extract(m["payload"], rf"(?m)^{name}: ([^\r\n]*)", 1))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row a capture of archives that write_archives made: page_id (string), payload_bytes, payload_digest (both of the
    full payload, for a revisit that of the response it refers to, recomputed from what was read), record_type, refers_to
    (the response's page_id), url."""
    held = Stored(captures(read_stored(spark, folder), payload=False).select(
        "capture_id", "target_uri", noted(F.col("metadata"), "page_id").alias("page_id"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_sha1",
    ))
    full = held.rows.where("type = 'response'").select(
        F.col("capture_id").alias("there"), F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_sha1").alias("full_sha1")
    )
    rows = held.rows.join(full, F.col("refers_to") == F.col("there"), "left")
    again = F.col("type") == "revisit"
    return rows.select(
        "page_id", F.when(again, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(again, F.col("full_sha1")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), F.col("target_uri").alias("url"),
    )


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    """read_records, read once: kept in a table without the payloads of primary records."""
    slim = F.when(~F.col("type").isin(*PRIMARY), F.col("payload"))
    return Stored(read_records(spark, folder).withColumn("payload", slim)).rows
