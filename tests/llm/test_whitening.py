"""Whitening: refined eigenvectors on hard spectra, exact sums, edge cases and the whole result."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from callbook.llm.whitening import _deviation, by_component, eigen, query, refine, whiten

SCHEMA = "vec_id long, embedding array<double>"


def spectrum(kind: str, d: int) -> np.ndarray:
    if kind == "spread":
        return np.logspace(6, -6, d)
    if kind == "clustered":
        return np.concatenate([1e5 + np.arange(d // 2) * 1e-4, 10 + np.arange(d - d // 2) * 1e-9])
    if kind == "equal":
        return np.full(d, 7.0)
    return np.concatenate([[3.0, 3.0, 2.0], np.zeros(d - 3)])


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "low rank"])
@pytest.mark.parametrize("d", [5, 40])
def test_refined_to_double_precision(kind, d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * spectrum(kind, d)) @ q.T
    v = (v + v.T) / 2
    values, x = eigen(v)
    norm = np.abs(v).max()
    assert np.abs(x.T @ x - np.eye(d)).max() < 5e-15
    assert np.abs(v.astype(np.longdouble) @ x - x * values).max() < 1e-14 * d * norm
    assert np.all(np.diff(values) <= 1e-13 * norm)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-14 * d * norm)


def test_float32_start_is_much_worse():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    v = (q * spectrum("clustered", 30)) @ q.T
    v = (v + v.T) / 2
    start = np.linalg.eigh(v.astype(np.float32))[1].astype(float)
    error = lambda x: np.abs(x.T @ v @ x - np.diag(np.diag(x.T @ v @ x))).max()
    assert error(eigen(v)[1]) < 1e-4 * error(start)
    values, x = refine(v, start)
    assert float(np.abs(x.T @ x - np.eye(30)).max()) < 1e-17


def test_deviation_is_exact():
    rng = np.random.default_rng(1)
    for n, size in ((3, 50), (10**6, 2000), (10**9, 5000)):
        x = rng.integers(10**5 - size, 10**5 + size, (6, 7))
        sums = [n * 10**5 + int(k) for k in rng.integers(-n, n, 7)]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        assert _deviation(x, n, sums) == [t if t < 2**63 else None for t in want]


def plain(rows):
    """x-vectors, exact sums and covariance of the rows by fractions."""
    x = [[int((Fraction(c) * 1024).__floor__()) + 100_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = [[float(sum((r[a] - mean[a]) * (r[b] - mean[b]) for r in x) / n) for b in range(d)] for a in range(d)]
    return x, sums, mean, np.array(v)


def test_whole_result_against_fractions(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((60, 5)) * [3, 2, 1, 0.5, 0.5]).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])] * 20
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "'x' as n", "1 as component", "2 as whitened")
    got = by_component(whiten(df.repartition(4))).collect()
    x, sums, mean, v = plain([r[1] for r in rows])
    values, u = np.linalg.eigh(v)
    values, u = values[::-1], u[:, ::-1]
    n = len(x)
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = [np.sign(by[1, k + 1][0].whitened * float(sum((a - m) * Fraction(c) for a, m, c in zip(x[1], mean, u[:, k], strict=True)))) for k in range(5)]
    for i in range(60):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        for k in range(5):
            found = by[i, k + 1]
            assert len(found) == (21 if i == 0 else 1)
            want = signs[k] * float(sum((a - m) * Fraction(c) for a, m, c in zip(x[i], mean, u[:, k], strict=True))) / values[k] ** 0.5
            for r in found:
                assert r.deviation == deviation and abs(r.whitened - want) < 1e-9
                assert abs(r.explained - values[k] / values.sum()) < 1e-12 and r.identity_error < 1e-10


def test_edge_cases(spark):
    assert by_component(whiten(spark.createDataFrame([], SCHEMA))).count() == 0
    assert by_component(whiten(spark.createDataFrame([(1, None)], SCHEMA))).count() == 0
    same = whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, SCHEMA))
    rows = by_component(same).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in rows)
    flat = by_component(whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], SCHEMA))).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-10 for r in flat)
    decimal = spark.createDataFrame([(1, [Decimal("1.5")]), (2, [Decimal("2.5")])], "vec_id long, embedding array<decimal(10,3)>")
    assert sorted(abs(r.whitened) for r in by_component(whiten(decimal)).collect()) == [1.0, 1.0]


def test_query(spark, sf_dir):
    found = query(spark, sf_dir).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert len(found) == 8 * len(vectors)
    x = {i: np.floor(1024 * np.array(v, float)).astype(int) + 100_000 for i, v in vectors.items()}
    sums, n = np.sum(list(x.values()), 0), len(x)
    white = np.zeros((n, 8))
    number = {i: k for k, i in enumerate(x)}
    for r in found:
        white[number[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum(int(n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True)) and r.identity_error < 1e-10
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-10
    v = np.cov(np.stack(list(x.values())).T, bias=True)
    share = {r.component: r.explained for r in found}
    assert np.allclose([share[k + 1] for k in range(8)], np.linalg.eigvalsh(v)[::-1][:8] / np.trace(v), rtol=1e-10)
