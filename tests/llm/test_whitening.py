from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, deviation string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "own") for i, v in rows], SCHEMA)


def brute(rows, size):
    """x, exact mean, covariance in Fractions of the vectors of this length."""
    xs = [(i, [floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    n = len(xs)
    mean = [Fraction(sum(x[j] for _, x in xs), n) for j in range(size)]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for _, x in xs) / n for j in range(size)] for i in range(size)]
    return xs, mean, cov


def check(rows, got, size, components=32):
    xs, mean, cov = brute(rows, size)
    n, trace = len(xs), sum(cov[j][j] for j in range(size))
    plain = np.array(cov, float)
    values = np.linalg.eigvalsh(plain)[::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-6
        assert abs(r.explained - values[r.component - 1] / float(trace)) <= 1e-6 * r.explained
    devs = {}
    for i, x in xs:
        devs.setdefault(i, set()).add(sum((n * x[j] - n * mean[j]) ** 2 for j in range(size)))
    assert all(r.deviation in devs[r.vec_id] for r in got)
    ids = sorted(by)
    if len(set(ids)) == n:
        w = np.array([[by[i][c][0].whitened for c in range(1, k + 1)] for i in ids])
        centred = np.array([[float(a - m) for a, m in zip(x, mean, strict=True)] for _, x in sorted(xs)])
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
        # each component is an eigenvector: the covariance with x gives it back times its eigenvalue
        onto = centred.T @ w / n / np.sqrt(values[:k])
        assert np.abs(plain @ onto - onto * values[:k]).max() < 1e-7 * values[0]


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [3, 1, 1, 0.2, 2] + 7).tolist()) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    got = whitening.report(vectors(spark, rows)).collect()
    check(rows, got, 5)
    check(rows, whitening.report(vectors(spark, rows), components=2).collect(), 5, 2)


def test_dependent_constant_and_repeated(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        a, b, c = (int(v) for v in rng.integers(-50, 50, 3))
        rows.append((i, [a / 64, a / 64, 5.0, (a + b) / 64, c / 64]))
    got = whitening.report(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(rows, got, 5)
    twice = rows + rows[:10] + [(None, rows[3][1])]
    again = whitening.report(vectors(spark, twice)).collect()
    assert len(again) == 51 * 3 and sum(r.vec_id is None for r in again) == 3


def test_scales_far_apart_keep_their_precision(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (np.round(rng.normal(size=4) * [1e6, 1e3, 1, 40]) / 64).tolist()) for i in range(300)]
    got = whitening.report(vectors(spark, rows)).collect()
    assert len(got) == 1200 and got[0].identity_error < 1e-6
    _, _, cov = brute(rows, 4)
    share = {r.component: r.explained for r in got}
    # exact: the characteristic polynomial of the rational covariance changes sign within 0.01 % of each eigenvalue
    trace = sum(cov[j][j] for j in range(4))

    def det(m):
        m, out = [r[:] for r in m], Fraction(1)
        for k in range(len(m)):
            out *= m[k][k]
            for r in range(k + 1, len(m)):
                f = m[r][k] / m[k][k]
                m[r] = [a - f * b for a, b in zip(m[r], m[k], strict=True)]
        return out

    for s in share.values():
        low, high = (Fraction(s) * trace * Fraction(10000 + d, 10000) for d in (-1, 1))
        signs = [det([[cov[i][j] - (e if i == j else 0) for j in range(4)] for i in range(4)]) > 0 for e in (low, high)]
        assert signs[0] != signs[1]


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whitening.report(vectors(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])]
    got = whitening.report(vectors(spark, rows)).collect()
    assert len(got) == 6 and all(np.isfinite(r.whitened) for r in got)
    assert {r.deviation for r in got} == {None} or any(r.deviation is None for r in got)


def test_exact_products_of_any_size():
    rng = np.random.default_rng(1)
    z = rng.integers(-(1 << 53), 1 << 53, (50, 3))
    plain = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(3)] for i in range(3)]
    assert whitening.exact_products(z).tolist() == plain


def test_own_columns_stay(spark):
    df = vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (4, None)])
    model = whitening.fit(df)
    rows = whitening.whiten(df, model)
    assert rows.columns == ["vec_id", "embedding", "deviation", "deviation_", "whitened"]
    assert sorted((r.vec_id, r.deviation) for r in rows.collect()) == [(1, "own"), (2, "own"), (3, "own")]


def test_query(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(150).collect()]
    small = vectors(spark, rows)
    check(rows, whitening.report(small).collect(), 64)
    assert queries.op11_whitening(spark, "/root/testdata/sf0.001").where(F.col("component") == 32).count() == 500


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_rounds_meet_every_pair_once(n):
    pairs = [tuple(sorted(x)) for p, q in whitening._rounds(n) for x in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
