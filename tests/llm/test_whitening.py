"""Whitening against exact whole numbers and a dense eigenvalue solver."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equigroup.llm import queries
from equigroup.llm import whitening as W

from .helpers import CLASHES

SCHEMA = "vec_id long, embedding array<double>"


def integers(rows, scale=64, shift=1_000_000):
    return [(i, [int(np.floor(scale * c)) + shift for c in v]) for i, v in rows]


def check(df, rows, components=32):
    """``rows`` are the (id, vector) that take part."""
    xs = integers(rows)
    n, d = len(xs), len(xs[0][1])
    sums = [sum(x[j] for _, x in xs) for j in range(d)]
    whole = [[n * x[j] - sums[j] for j in range(d)] for _, x in xs]
    v = np.array([[sum(w[i] * w[j] for w in whole) / n ** 3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > d * 2.0 ** -50 * values[0]).sum())
    k = min(components, rank)
    out = df.orderBy("vec_id", "component").collect()
    assert len(out) == n * k and {r["n"] for r in out} <= {n}
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], []).append(r)
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] <= 1e-9
    wanted = np.array(whole) / n @ vectors[:, :k] / np.sqrt(values[:k])
    sign = None
    for (i, _), w, line in zip(xs, whole, wanted):
        rs = got[i]
        assert [r["component"] for r in rs] == list(range(1, k + 1))
        assert {r["deviation"] for r in rs} == {sum(c * c for c in w)}
        assert np.allclose([r["explained"] for r in rs], values[:k] / values.sum(), rtol=1e-9)
        if sign is None and np.abs(line).min() > 1e-6:
            sign = np.sign(line) * np.sign([r["whitened"] for r in rs])
    assert sign is not None
    for (i, _), line in zip(xs, wanted):
        assert np.allclose([r["whitened"] for r in got[i]], line * sign, atol=1e-7)


@pytest.mark.parametrize("n, d", [(40, 3), (80, 7), (120, 40), (6, 9)])
def test_against_a_dense_solver(spark, n, d):
    r = random.Random(n + d)
    rows = [(i, [r.gauss(0, 1 + j) + 0.5 * (i % 3) for j in range(d)]) for i in range(n)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows)


def test_large_shifts_and_components(spark):
    """A common offset and huge components cost no digits of the deviations."""
    r = random.Random(5)
    rows = [(i, [2.0 ** 30 + r.gauss(0, 2), 2.0 ** 33 * r.random(), r.gauss(0, 50.0)]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.whiten(df).collect()
    xs = integers(rows)
    sums = [sum(x[j] for _, x in xs) for j in range(3)]
    exact = {i: sum((30 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in xs}
    assert {r["vec_id"]: r["deviation"] for r in out} == {i: v if v < 2 ** 63 else None for i, v in exact.items()}
    assert any(v >= 2 ** 63 for v in exact.values())
    whole = W.exact_scatter(W.usable_vectors(df), 3, 30, sums, 64, 1_000_000)
    assert whole == [[sum((30 * x[i] - sums[i]) * (30 * x[j] - sums[j]) for _, x in xs) // 30 for j in range(3)] for i in range(3)]


def test_deviation_near_the_limit_of_a_long():
    m = W.Whitening(2, 1, [0, 0], np.eye(2), np.ones(2), np.ones(2))
    root = 3_037_000_499  # its square is just below 2^63
    x = np.array([[root, 0], [root, 1], [root, 100_000], [root + 1, 0], [2 ** 33, 2 ** 33], [3, -4]])
    assert m.deviation(x) == [v if v < 2 ** 63 else None for v in (int(a) ** 2 + int(b) ** 2 for a, b in x.tolist())]


def test_factor_and_rotation():
    rng = np.random.default_rng(2)
    b = rng.normal(size=(9, 9)) * np.logspace(0, -4, 9)[:, None]
    v = b @ b.T
    a = W.pivoted_cholesky(v)
    assert np.allclose(a @ a.T, v, rtol=0, atol=1e-14 * v.max())
    assert sorted((a != 0).sum(axis=1)) == list(range(1, 10))  # triangular under a permutation of the rows
    values, vectors = W.jacobi_columns(a)
    assert np.allclose(vectors.T @ vectors, np.eye(9), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, v, atol=1e-13 * v.max())
    assert np.allclose(values, np.linalg.svd(b, compute_uv=False) ** 2, rtol=1e-5)
    assert W.pivoted_cholesky(np.outer([1.0, 2, 3], [1, 2, 3])).shape == (3, 1)
    assert W.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_query_over_a_table(spark, sf_small):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, sf_small), rows)


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 4.0]), (3, [5.0, -1.0])]
    odd = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e300, 1.0])]
    df = spark.createDataFrame(good + odd, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ["id", "x", "w", "at", "deviation", *CLASHES]])
    check(W.whiten(df), good)
    twice = spark.createDataFrame(good + [(None, [1.0, 2.0]), (0, [1.0, 2.0])], SCHEMA)
    out = W.whiten(twice).collect()
    assert len(out) == 12 and {r["n"] for r in out} == {6} and sum(r["vec_id"] is None for r in out) == 2
    for empty in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert W.whiten(spark.createDataFrame(empty, SCHEMA)).count() == 0
