import random

from quirelake.llm.components import components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        if a != b:
            root[y] = x
    return sorted((x, find(x)) for x in root if any(x in p and p[0] != p[1] for p in links))


def test_chains_stars_and_random_links(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(500, i) for i in range(501, 520)] + [(i, 499) for i in (505, 510)]
    mixed = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)]
    back = [(i, i - 7) for i in range(2000, 2050, 7)]
    links = chain + star + mixed + back + [(7, 7), (8, 9), (9, 8), (8, 9)]
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
