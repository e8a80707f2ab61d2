from __future__ import annotations

import math

import numpy as np

from scoreline.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x string, n int, k string"


def frame(spark, vectors):
    rows = [(i, v, "x", 1, "k") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_force(vectors, components=4):
    """By id: deviation and, per component, whitened (sign free) and explained, from a dense eigen solver."""
    good = {
        i: [math.floor(256 * float(np.float32(c))) for c in v]
        for i, v in vectors.items()
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    width = max(map(len, good.values()))
    good = {i: v + [0] * (width - len(v)) for i, v in good.items()}
    fit = sorted(set(map(tuple, good.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(x.T @ x / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    keep = values > 1e-9 * values[0]
    out = {}
    for i, v in good.items():
        y = (np.array(v, float) - np.array([s / n for s in sums])) @ axes
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(v, sums)), (y / np.sqrt(np.maximum(values, 1e-300)))[keep],
                  (values / (x * x).sum() * n)[keep])
    return n, out


def agrees(df, vectors, exact=True):
    n, want = brute_force(vectors)
    got = df.toPandas()
    assert set(got.vec_id) == set(want) and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    signs = {}
    for r in got.sort_values(["vec_id", "component"]).itertuples():
        deviation, y, explained = want[r.vec_id]
        assert r.deviation == deviation and abs(r.explained - explained[r.component - 1]) < 1e-10
        if exact and abs(y[r.component - 1]) > 1e-3:
            sign = signs.setdefault(r.component, np.sign(y[r.component - 1] * r.whitened))
            assert abs(sign * r.whitened - y[r.component - 1]) < 1e-7
    assert len(got) == sum(len(y) for _, y, _ in want.values())


def test_given_vectors_agree_with_a_dense_solver(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    agrees(whitening.whitened(df), {r.vec_id: list(r.embedding) for r in df.collect()})


def test_unusable_repeated_and_ragged_vectors(spark):
    draw = np.random.default_rng(1)
    vectors = [list(map(float, draw.standard_normal(6) * [9, 5, 3, 2, 1, 0.5])) for _ in range(80)]
    vectors += vectors[:20] * 3 + [vectors[0]] * 200 + [v[:4] for v in vectors[:10]] + [[], [0.0, -0.0]]
    vectors += [None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [1.0, float("inf")], [float("-inf")]]
    agrees(whitening.whitened(frame(spark, vectors)), dict(enumerate(vectors)))


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 1.0]), (7, [0.0, 5.0]), (7, [0.0, 5.0])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.count() == 8 and found.where("vec_id IS NULL").count() == 4


def test_fewer_directions_than_components(spark):
    draw = np.random.default_rng(2)
    line = [[float(a), float(2 * a), 5.0] for a in draw.integers(-50, 50, 60)]
    agrees(whitening.whitened(frame(spark, line)), dict(enumerate(line)))
    plane = [[float(a), float(b), float(a + b), 1.0, 0.0] for a, b in draw.integers(-9, 9, (90, 2))]
    agrees(whitening.whitened(frame(spark, plane)), dict(enumerate(plane)))


def test_equal_variances_need_new_starts(spark):
    corners = [[float(s if i == k else 0) for i in range(6)] for k in range(6) for s in (1, -1)]
    df = whitening.whitened(frame(spark, corners))
    agrees(df, dict(enumerate(corners)), exact=False)  # any basis is right
    assert df.count() == 4 * len(corners)


def test_large_entries_have_exact_deviations(spark):
    draw = np.random.default_rng(3)
    vectors = [list(map(float, draw.integers(-(10**6), 10**6, 3))) for _ in range(50)]
    n, want = brute_force(dict(enumerate(vectors)))
    for r in whitening.whitened(frame(spark, vectors)).collect():
        exact = want[r.vec_id][0]
        assert r.deviation == (exact if exact < 2**63 else None)
    huge = vectors + [[3e38, -3e38, 1.0]]
    assert whitening.whitened(frame(spark, huge)).count() >= len(huge)


def test_nothing_to_whiten(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [None, [float("nan")]])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whitened(frame(spark, [[], []])).count() == 0


def test_left_vectors_stay_orthogonal():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((300, 40)) * np.logspace(0, -4, 40)
    x -= x.mean(axis=0)
    values, axes = whitening.bidiagonalise(lambda w: (x.T @ (x @ w), float((x @ w) @ (x @ w))), 40, 4)
    _, want, rows = np.linalg.svd(x)
    assert np.allclose(values, want[:4], rtol=1e-12)
    assert np.allclose(np.abs(np.sum(axes * rows[:4].T, axis=0)), 1, atol=1e-12)
