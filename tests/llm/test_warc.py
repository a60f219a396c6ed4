import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirelake.llm import warc

SEP = "\r\n\r\nWARC/1.1\r\n"
FAKE = f"<p>{SEP}WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:fake>\r\nContent-Length: 99999\r\n\r\n</p>{SEP}x"
PAGES = [
    (1, "http://a.example.com/x?q=1#f", "<p>one</p>"), (2, "https://B.example.com", "<p>one</p>"), (3, None, None), (4, "no scheme", ""),
    (5, "http://c.example.com/a b\r\nSet: x", "<p>é ß \U0001f600</p>\r\n\r\n"), (6, "http://d.example.com/", FAKE), (7, "http://d.example.com/", FAKE),
    (8, "http://e.example.com/", SEP), (9, "http://e.example.com/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (9, "http://e.example.com/", "other\r\n\r\n\r\n\r\n"),
    (2, "https://B.example.com", "<p>one</p>"), (1, "http://a.example.com/x?q=1#f", "<p>one</p>"), (None, "http://f.example.com", "<p>one</p>"), (None, None, "only"),
    (10, "http://g.example.com", "long " * 60000), (11, "http://g.example.com", "z" + SEP[:-1]), (12, "http://h.example.com", f"a{SEP}b{SEP}c{SEP}d"),
]


def pages(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("own")).repartition(parts)


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to), sorted."""
    groups, out = {}, []
    for i, _, t in rows:
        groups.setdefault((t or "").encode(), []).append(i)
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            first = k == 0 or len(data) < least
            out.append((i, len(data), b32(data), "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=str)


def told(spark, folder):
    kept = warc.page_report(spark, folder).selectExpr("cast(page_id as long) as i", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as long) as r")
    return sorted(map(tuple, kept.collect()), key=str)


@pytest.mark.parametrize(("codec", "least"), [("gzip", 0), ("none", 4)])
def test_round_trip_of_odd_pages(spark, tmp_path, codec, least):
    folder = str(tmp_path / "a")
    warc.write_archives(pages(spark, PAGES), folder, codec=codec, least=least)
    assert told(spark, folder) == expected(PAGES, least)
    whole = warc.captures(warc.read_records(spark, folder)).collect()
    assert len(whole) == len(PAGES) == len({c.capture_id for c in whole})
    for c in whole:
        assert len(c.requests) == 1 and len(c.metadata) == 1 and c.response is not None and not c.response.broken
        assert c.requests[0].http.startswith("GET /") and "\r\nHost:" in c.requests[0].http
    got = sorted(c.response.payload for c in whole if c.response.type == "response" and c.response.payload_bytes >= 4)
    assert got == sorted({t for *_, t in PAGES if t and len(t.encode()) >= 4})
    assert {c.target_uri for c in whole if c.target_uri and "c.example" in c.target_uri} == {"http://c.example.com/a%20b%0D%0ASet:%20x"}


def test_files_are_plain_warc(spark, tmp_path):
    """Records as a reader of its own finds them, by their lengths alone."""
    folder = tmp_path / "a"
    warc.write_archives(pages(spark, PAGES), str(folder))
    kinds, ids = [], []
    for file in folder.glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            if fields[b"WARC-Type"] == b"response":
                payload = rest[:n].partition(b"\r\n\r\n")[2]
                assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + b32(payload)
            kinds.append(fields[b"WARC-Type"].decode())
            ids.append(fields[b"WARC-Record-ID"])
            data = rest[n + 4 :]
    assert len(kinds) == 3 * len(PAGES) == len(set(ids)) and kinds.count("request") == len(PAGES)
    assert kinds.count("response") == len({t or "" for *_, t in PAGES})


def test_large_plain_files_are_split(spark, tmp_path):
    folder = str(tmp_path / "a")
    rows = [(i, f"http://a.example.com/{i}", f"page {i} " + "\r\n\r\n\r\nWARC/1.1\r" * (i % 5) + "é" * (i % 97)) for i in range(3000)]
    warc.write_archives(pages(spark, rows, 1), folder, codec="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert warc.read_records(spark, folder).rdd.getNumPartitions() > 4
        assert told(spark, folder) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def records(spark, rows):
    schema = "record_id string, type string, concurrent_to array<string>"
    more = {c: F.lit(None).cast("string") for c in ("date", "target_uri", "refers_to", "payload_digest", "http", "payload", "payload_sha1")}
    return spark.createDataFrame(rows, schema).withColumns(more | {"payload_bytes": F.lit(0).cast("long"), "broken": F.lit(False)})


def test_transactions_of_other_writers(spark):
    """Links by the response, chains over a request, several metadata records, and records that lead nowhere."""
    rows = [
        ("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1"]),
        ("r2", "revisit", []), ("q2", "request", ["r2"]), ("m3", "metadata", ["r2"]), ("m4", "metadata", ["r2", "q2"]),
        ("q3", "request", ["gone"]), ("m5", "metadata", ["gone"]), ("m6", "metadata", []), ("r3", "resource", []),
    ]
    got = {c.capture_id: (c.response and c.response.record_id, [q.record_id for q in c.requests], [m.record_id for m in c.metadata]) for c in warc.captures(records(spark, rows)).collect()}
    assert got == {
        "r1": ("r1", ["q1"], ["m1", "m2"]), "r2": ("r2", ["q2"], ["m3", "m4"]), "gone": (None, ["q3"], ["m5"]), "m6": (None, [], ["m6"]), "r3": ("r3", [], []),
    }


def test_cut_off_records_are_marked(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a{}>\r\nContent-Length: {}\r\n\r\n{}"
    (tmp_path / "a").mkdir()
    Path(tmp_path / "a" / "x.warc").write_bytes("\r\n\r\n".join([head.format(1, 3, "abc"), head.format(2, 9, "abc"), ""])[:-4].encode())
    got = {r.record_id: r.broken for r in warc.read_records(spark, str(tmp_path / "a")).collect()}
    assert got == {"urn:a1": False, "urn:a2": True}


def test_empty_table(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "a"))
    assert told(spark, str(tmp_path / "a")) == []
