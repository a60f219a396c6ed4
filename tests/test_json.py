"""Links in nested JSON of any depth against a walk in plain Python."""

import json
import random

from quirelake.sources import scan


def walk(value, path=""):
    """(url, path) of every link, fields in order of their names."""
    children = sorted(value.items()) if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []
    for n, (name, v) in enumerate(children):
        at = f"{path}/{n:09d}"
        if name in ("url", "signed_url") and isinstance(v, str) and v.startswith(("http://", "https://")):
            yield v, at
        yield from walk(v, at)


def made(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["http://a.example/1", "https://b.example/2", "ftp://c", 5, None, True, "text"])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["url", "signed_url", "data", "n", "x"]): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_links_at_every_depth(spark):
    rng = random.Random(6)
    values = [made(rng, rng.randint(1, 11)) for _ in range(120)]
    deep = {"url": "https://deep.example/0"}
    for _ in range(13):
        deep = {"a": [deep]}
    values += [deep, {}, [], "https://alone.example", {"url": {"url": "http://in.example"}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "no json {"), (902, "")]
    want = {}
    for i, v in enumerate(values):
        for url, path in walk(v):
            want[i, url] = min(path, want.get((i, url), path))
    got = scan.harvested_urls(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()
    assert {(r.id, r.url): r.path for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    assert scan.harvested_urls(spark.createDataFrame([], "id long, j string"), "id", "j").count() == 0
