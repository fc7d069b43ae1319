"""Approximate nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from faultloom.llm import ann


def brute(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        found = []
        for i, w in vectors:
            if i != q and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                found.append((-round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 10), i))
        out[q] = sorted(set(found))[:k]
    return out


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def odd_rows():
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)]
    rows += [(400 + i, rng.standard_normal(3).tolist()) for i in range(4)]
    rows += [(500, None), (550, []), (600, [0.0] * 8), (650, [None] + [1.0] * 7), (700, [float("nan")] * 8), (750, [float("inf")] + [0.0] * 7)]
    rows += [(None, [1.0] * 8), (50, rows[50][1]), (800, [1e-200] * 8), (850, [1e200] * 8)]
    return rows


@pytest.mark.parametrize("shard_points", [16_384, 60])
def test_small_tables_are_exact(spark, shard_points):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, shard int").repartition(4)
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), k=5, shard_points=shard_points).collect()
    valid = [(i, [x * (1 / max(map(abs, v))) for x in v]) for i, v in rows if i is not None and v is not None and usable(v)]
    want = brute(valid, {i: v for i, v in valid if i % 50 == 0}, 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-round(r["score"], 10), r["vec_id"]))
    assert found == {q: w for q, w in want.items() if w}


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), shard_points=900)
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    ids = np.array(sorted(rows))
    unit = ann._unit(np.array([rows[i] for i in ids], float))
    hits = total = 0
    for q in (i for i in ids if i % 50 == 0):
        scores = unit @ unit[np.searchsorted(ids, q)]
        scores[np.searchsorted(ids, q)] = -2
        best = set(ids[np.argsort(-scores, kind="stable")[:5]])
        hits += len(best & {r["vec_id"] for r in got.filter(got.query_id == int(q)).collect()}) if total < 50 else 0
        total += 5 if total < 50 else 0
    assert hits / total >= 0.9


def test_graph_recall():
    rng = np.random.default_rng(6)
    points = ann._unit(rng.standard_normal((3000, 24))).astype(np.float32)
    edges, entry = ann.build(points)
    assert ((edges >= 0).sum(axis=1) > 0).all()
    queries = points[::30]
    found, far = ann.search(points, edges, entry, queries, 64)
    assert (np.diff(far, axis=1) >= 0).all()
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b[:6])) / 6 for a, b in zip(exact, found)]) >= 0.95


def test_pruning_keeps_diverse_neighbours():
    points = ann._unit(np.array([[1, 0], [1, 0.1], [1, 0.11], [1, -0.2], [0, 1]], float)).astype(np.float32)
    kept = ann.prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, 1]]), 4, 1.2)[0]
    assert list(kept[kept >= 0]) == [1, 3, 4]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(50, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0
    assert ann.nearest(some, some).count() == 0
    assert ann.nearest(none, some).count() == 0
