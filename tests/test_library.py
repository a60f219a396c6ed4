"""The stored library: saves, later saves, refused rows, broken saves and look-ups."""

from quirelake.sources.library import Library

SCHEMA = "query string, subject string, orientation string, source string, source_url string, identifier string, licence string, author string, payload binary, n long"


def answer(query, name, n=0, source="pexels", payload=b"\xff\xd8" + b"x" * 2000, subject="s"):
    return (query, subject, "landscape", source, "u", name, "l", "a", payload, n)


def asked(spark, *queries):
    return spark.createDataFrame([(q, "s", "landscape") for q in queries], "query string, subject string, orientation string")


def found(kept, df):
    return {r.query: r.identifier for r in kept.find(df).collect()}


def test_save_again_and_look_up(spark, tmp_path):
    kept = Library(spark, f"{tmp_path}/lib", buckets=8)
    assert found(kept, asked(spark, "one")) == {"one": None}
    small, large = b"\xff\xd8" + b"x" * 1022, b"\xff\xd8" + b"x" * (22 * 1024 * 1024 - 1)
    rows = [answer("One ", "first", 1), answer(" one", "second", 2), answer("two", "t"), answer("bad", "b", payload=b"GIF8" * 900), answer("other", "o", source="elsewhere"), answer("small", "s", payload=small), answer("large", "l", payload=large)]
    kept.save(spark.createDataFrame(rows, SCHEMA), "n")
    queries = asked(spark, "ONE", "two", "bad", "other", "small", "large", "none")
    assert found(kept, queries) == {"ONE": "second", "two": "t", "bad": None, "other": None, "small": None, "large": None, "none": None}
    assert kept.rows().count() == 4
    kept.save(spark.createDataFrame([answer("one", "third", 0), answer("small", "now", payload=small + b"x")], SCHEMA), "n")
    assert found(kept, queries) == {"ONE": "third", "two": "t", "bad": None, "other": None, "small": "now", "large": None, "none": None}


def test_only_touched_buckets_are_written_and_a_broken_save_is_not_seen(spark, tmp_path):
    kept = Library(spark, f"{tmp_path}/lib", buckets=16)
    kept.save(spark.createDataFrame([answer(f"q{i}", f"a{i}") for i in range(100)], SCHEMA), "n")
    kept.save(spark.createDataFrame([answer("q7", "new")], SCHEMA), "n")
    assert len(list((tmp_path / "lib/data/n-000000000002").glob("bucket=*"))) == 1
    names = [f"q{i}" for i in range(100)]
    want = {f"q{i}": f"a{i}" for i in range(100)} | {"q7": "new"}
    assert found(kept, asked(spark, *names)) == want
    # a save that ended before its manifest was complete
    (tmp_path / "lib/manifest/n-000000000003").mkdir()
    assert found(Library(spark, f"{tmp_path}/lib", buckets=16), asked(spark, *names)) == want
    kept.save(spark.createDataFrame([answer("q8", "newer")], SCHEMA), "n")
    assert found(kept, asked(spark, "q8", "q7", "q9")) == {"q8": "newer", "q7": "new", "q9": "a9"}
    kept.tidy()
    assert found(kept, asked(spark, *names)) == want | {"q8": "newer"}
    kept.save(spark.createDataFrame([answer("x", "y", source="elsewhere")], SCHEMA), "n")
    assert found(kept, asked(spark, "x")) == {"x": None}
