import hashlib

import numpy as np
import pyarrow as pa
from helpers import ODD, given, table

from quirelake.llm import fingerprint as fp
from quirelake.llm.common import hashed_words


def expected(rows):
    """What must come out but for the fingerprints: (doc_id, n_chars, edited_sha256)."""
    known = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1].encode()))
    out = []
    for k, (i, t) in enumerate(known):
        n = known[(k + 1) % len(known)][1]
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    for i, t in rows:
        if i is None:
            t = t or ""
            q = len(t) // 4
            out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + t[:q]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edits_against_plain_python(spark):
    for docs in (table(spark, ODD), given(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = fp.edit_report(docs).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == expected(rows)
        prints = {}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    long = [r for r in got if r.n_chars > 3000]
    assert np.mean([r.near_edited for r in long]) > 0.45 > 0.1 > np.median([r.near_next for r in long])


def test_empty_table(spark):
    assert fp.edit_report(table(spark, [])).count() == 0


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    import quirelake.llm.common as common

    texts = pa.array(["alpha beta\x0bgamma", None, "", "  beta\tALPHA ", "x" * 300 + " y", "é ß alpha"])
    whole, at = hashed_words(texts)
    assert at.tolist() == [0, 3, 3, 3, 5, 7, 10]
    assert whole[1] == whole[3] and whole[0] == whole[9] and len(set(whole)) == 8
    assert hashed_words(texts, lower=True)[0][4] == whole[0]
    monkeypatch.setattr(common, "_SLICE", 16)
    sliced, again = hashed_words(texts)
    assert (sliced == whole).all() and (again == at).all()


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(20000)]
    a, b = fp.sketches(pa.array([" ".join(words), " ".join(words[:5000])]))
    assert abs(len(a) / 19996 - 1 / fp.SCALE) < 0.02
    rows = spark.createDataFrame([(" ".join(words[:5000]), " ".join(words))], "x string, y string")
    rows = rows.select(fp.fingerprint("x").alias("x"), fp.fingerprint("y").alias("y"))
    got = rows.select(fp.containment("x", "y").alias("c"), fp.containment("y", "x").alias("d"), (fp.merged("x", "y") == rows["y"]).alias("m")).first()
    assert got.c == 1.0 and abs(got.d - 0.25) < 0.05 and got.m


def test_sketches_and_likeness_by_hand(spark):
    from quirelake.llm.common import shingle_hashes

    texts = ["a b c", "", "  ", " ".join(f"w{i % 37}" for i in range(400)), " ".join(f"v{i}" for i in range(90)), "one two three four five six seven"]
    for text, sketch in zip(texts, fp.sketches(pa.array(texts)), strict=True):
        words = hashed_words(pa.array([text]))[0]
        windows = [words[i : i + 5] for i in range(len(words) - 4)]
        all_ = {int(shingle_hashes(w, 5)[0]) >> 32 for w in windows} or {int(shingle_hashes(words, len(words))[0] ^ np.uint64(len(words))) >> 32 for _ in range(len(words) > 0)}
        assert set(sketch.tolist()) == ({h for h in all_ if h < 2**32 // fp.SCALE} or set(sorted(all_)[:1]))
    for r in fp.edit_report(given(spark)).collect():
        own, other = set(fp.decoded(r.fingerprint).tolist()), set(fp.decoded(r.edited_fingerprint).tolist())
        assert r.near_edited == (len(own & other) / len(own | other) if own | other else 1.0)


def test_merged_sketches_are_those_of_the_union(spark):
    few, many = "one two three four five", " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(few, many), (many, few), (few, "six seven eight nine ten"), ("", many)], "x string, y string").select(fp.fingerprint("x").alias("x"), fp.fingerprint("y").alias("y"))
    for r in rows.withColumns({"m": fp.merged("x", "y"), "c": fp.containment("x", "y")}).collect():
        both = set(fp.decoded(r.x).tolist()) | set(fp.decoded(r.y).tolist())
        assert set(fp.decoded(r.m).tolist()) == ({h for h in both if h < 2**32 // fp.SCALE} or {min(both)})
        assert r.c is None or 0 <= r.c <= 1


def test_many_ranges_and_few_drawn_ids(spark, monkeypatch):
    """More ranges than ids, and bounds from a few drawn ids: the same edits, and no more on the driver than was drawn."""
    rows = [(7 * i, f"text {i} " * (i % 9)) for i in range(400)] + [(21, "again")] * 200
    want = expected(rows)
    docs = table(spark, rows)
    for parts, drawn in ((1000, 64), (10, 2)):
        monkeypatch.setattr(fp, "DRAWN", drawn)
        bounds, _ = fp._ranges(docs.select("doc_id"), 600, parts)
        assert len(bounds) <= min(parts, 401)
        schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        got = fp.with_next(docs, fp._edited, schema, parts=parts).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == want
