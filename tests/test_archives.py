"""The zip source: members of small, broken, empty and very large archives."""

import io
import zipfile

from quirelake.sources import archives, scan


def packed(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, n * 3)
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "x")
    return out.getvalue()


def test_listing_reads_the_directory_alone(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.zip").write_bytes(packed(["one", "dir/zwei é"]))
    (tmp_path / "in/deep/b.ZIP").write_bytes(packed([]))
    (tmp_path / "in/bad.zip").write_bytes(b"no archive at all")
    (tmp_path / "in/none.zip").write_bytes(b"")
    (tmp_path / "in/other.txt").write_bytes(packed(["not taken"]))
    with open(tmp_path / "in/large.zip", "wb") as f:  # 5 GB with a hole in front: nothing but its end is read
        f.seek(5 << 30)
        f.write(packed(["behind"]))
    got = archives.listed(spark, str(tmp_path / "in"), files=2)
    assert got.rdd.getNumPartitions() == 3
    rows = {(r.path.rsplit("/", 1)[1], r.pos, r.member, r.bytes, r.is_link, r.error) for r in got.collect()}
    bad = "not a readable archive"
    assert rows == {
        ("a.zip", 0, "one", 9, False, None), ("a.zip", 1, "dir/zwei é", 33, False, None), ("a.zip", 2, "link", 1, True, None), ("b.ZIP", 0, "link", 1, True, None),
        ("bad.zip", None, None, None, None, bad), ("none.zip", None, None, None, None, bad), ("large.zip", 0, "behind", 18, False, None), ("large.zip", 1, "link", 1, True, None),
    }
    assert archives.listed(spark, f"file://{tmp_path}/in/deep").count() == 1


def test_the_same_rows_from_contents(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(packed(["one", "two"]))
    (tmp_path / "b.zip").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    own = {tuple(r)[1:] for r in scan.archive_members(files).collect()}
    assert own == {tuple(r)[1:] for r in archives.listed(spark, str(tmp_path)).collect()}
    nothing = spark.createDataFrame([("x", None)], "path string, content binary")
    assert [r.error for r in scan.archive_members(nothing).collect()] == ["not a readable archive"]
