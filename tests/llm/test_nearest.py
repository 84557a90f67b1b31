"""Nearest neighbours: recall against brute force, ties, unusable vectors."""

import numpy as np
import pandas as pd
import pytest

from callbook.llm import nearest


def brute(rows, k, every=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[7]  # one vector held by a fifth of all rows
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (None, [1.0] * 16), (5080, [1.0, 2.0]), (5081, [3.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2.0 as score")
    got: dict = {}
    for r in nearest.nearest(df, k=10, shard_rows=400, degree=12, beam=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 10)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    x = {i: np.array(v, float) for i, v in rows if v is not None and None not in v}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert np.allclose([s for _, _, s in found], [x[q] @ x[v] for _, v, _ in found])
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert [v for _, v, _ in got[5080]] == [5081]
    # a hot vector's rows find each other, smallest ids first
    assert [v for _, v, _ in got[120]][:3] == [i for i, _ in [(v, 0) for _, v in want[120]]][:3]


def test_empty_and_single(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert nearest.nearest(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_different_vectors_under_one_id(spark):
    rows = [(20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(20, 1, 1, 2.0), (20, 2, 2, 0.0)]


def _recall(spark, x, k=20, **parameters):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in nearest.nearest(df, k=k, **parameters).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, len(x), 20)
    scores = x[asked].astype(float) @ x.T.astype(float)
    scores[np.arange(len(asked)), asked] = -np.inf
    hits = 0
    for q, row in zip(asked.tolist(), scores, strict=True):
        assert len(found[q]) == min(k, len(x) - 1)
        edge = np.sort(row)[-k]
        hits += sum(row[v] >= edge - 1e-9 for v in found[q])
    return hits / (k * len(asked))


@pytest.mark.parametrize("noise", [0.1, 0.4])
def test_recall_on_clusters_with_the_querys_parameters(spark, noise):
    rng = np.random.default_rng(7)
    unit = lambda a: (a / np.linalg.norm(a, axis=1, keepdims=True)).astype(np.float32)
    centres = unit(rng.normal(size=(100, 64)))
    x = unit(centres[rng.integers(0, 100, 8192)] + noise * unit(rng.normal(size=(8192, 64))))
    x[5000:6000] = x[17]  # and a vector that many rows hold
    assert _recall(spark, x) >= 0.95


def test_more_neighbours_than_the_beam_holds(spark):
    x = np.random.default_rng(3).normal(size=(600, 8)).astype(np.float32)
    assert _recall(spark, x, k=150, beam=40, degree=12, shard_rows=1000) >= 0.99


def _graph(n, seed=0, degree=24):
    x = np.random.default_rng(seed).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argpartition(-(x @ x.T) + 9 * np.eye(n), degree, 1)[:, :degree].astype(np.int64)
    return x, pd.DataFrame({"node": np.arange(n), "vector": list(x.astype(float)), "near": list(near)})


def test_a_search_takes_few_steps(monkeypatch):
    x, nodes = _graph(2048)
    asked = np.arange(0, 2048, 20)
    queries = pd.DataFrame({"query_id": asked, "vector": list(x[asked].astype(float)), "node": asked})
    calls, partition = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda *a, **k: calls.append(1) or partition(*a, **k))
    found = nearest._search(nodes, queries, 21, 220, 12)
    monkeypatch.undo()
    assert len(calls) < 100  # a step for each node of the beam were over 220
    best = np.argsort(-(x[asked] @ x.T), 1)[:, :21]
    got = found.groupby("query_id")["node"].apply(set)
    assert sum(len(got[q] & set(row.tolist())) for q, row in zip(asked.tolist(), best, strict=True)) >= 0.99 * best.size


def test_few_copies_of_a_shard_for_many_queries():
    # 60 blocks of queries on 150 shards: these are tasks enough
    assert nearest._parts(30_720, 150, 12, 512) == 2
    assert nearest._parts(2_565, 13, 12, 512) == 4
    assert nearest._parts(100, 1, 12, 512) == 1
    assert nearest._parts(0, 0, 12, 512) == 1
