"""Toxicity against plain Python versions of its features, ratios and optimum."""

import math
import zlib

import numpy as np
import pytest

from equigroup.llm import queries
from equigroup.llm import toxicity as T

from .helpers import awkward, clashing, empty

LABELS = "doc_id long, toxic int"
M64 = 2 ** 64


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def plain_slots(text):
    """The slots of a text, one n-gram after the other."""
    out, mix = set(), [int(m) for m in T._MIX]
    for word in text.lower().split():
        w = [ord(c) for c in f" {word} "]
        for size in T.SIZES:
            for i in range(len(w) - size + 1):
                h = (w[i] + 1) * mix[0] % M64
                for c in w[i + 1:i + size]:
                    h = (h * mix[1] + (c + 1) * mix[0]) % M64
                out.add((h ^ (h >> 32)) * mix[2] % M64 >> (64 - T.SPACE_BITS))
    return out


def test_slots_are_those_of_all_words(monkeypatch):
    texts = ["The cat sat, sat on the mat!", "", " \t\n", "a", "é😀 你好 straße İx", "x" * 50 + " " + "ab" * 40, "One two\x1cthree   four"]
    for size in (T.SLICE, 7, 10):
        monkeypatch.setattr(T, "SLICE", size)
        slots = T.Slots()
        for t in texts * 2:
            found = slots.of(t).tolist()
            assert len(found) == len(set(found)) and set(found) == plain_slots(t)


def _docs(spark):
    rows = [(i, f"quiet words of text {i % 7} here " * (1 + i % 3) + ("you moron go" if i % 4 == 0 else "")) for i in range(90)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), [(i, int(i % 4 == 0)) for i, _ in rows]


def test_whole_fit_matches_a_plain_version(spark):
    """Ratios, optimum and all scores of a table, from dense matrices."""
    rows, docs, labels = _docs(spark)
    model = T.fit_toxicity(docs, spark.createDataFrame(labels, LABELS), penalty=1.0)
    train = [(plain_slots(t), y) for (i, t), (_, y) in zip(rows, labels) if not held(i)]
    slots = sorted(set().union(*(s for s, _ in train)))
    y = np.array([v for _, v in train])
    a = np.array([[s in f for s in slots] for f, _ in train], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    p1, p0 = T.PRIOR * n1 / len(y), T.PRIOR * n0 / len(y)
    ratio = np.log((a[y == 1].sum(0) + p1) / (n1 + p1)) - np.log((a[y == 0].sum(0) + p0) / (n0 + p0))
    x = np.column_stack([a * ratio, np.ones(len(y))])
    cost = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    w = np.array([model.weights[s] / r if r else 0.0 for s, r in zip(slots, ratio)] + [model.intercept])

    def value(w):
        z = x @ w
        return (cost * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + 0.5 * w[:-1] @ w[:-1]

    best = w.copy()
    for _ in range(30):  # Newton's steps from the fitted point to the optimum
        p = 1 / (1 + np.exp(-(x @ best)))
        pen = np.append(np.ones(len(w) - 1), 0.0)
        g = x.T @ (cost * (p - y)) + pen * best
        best = best - np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(pen), g)
    assert value(best) <= value(w) <= value(best) * 1.002
    assert set(np.flatnonzero(model.weights).tolist()) <= set(slots)
    scored = {r["doc_id"]: r for r in T.score_toxicity(docs, model).collect()}
    for i, t in rows:
        z = model.intercept + sum(float(model.weights[s]) for s in plain_slots(t))
        r = scored[i]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-5 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(i)
        assert r["predicted"] == int(i % 4 == 0)


def test_held_out_labels_are_not_learned(spark):
    rows, docs, labels = _docs(spark)
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (T.score_toxicity(docs, T.fit_toxicity(docs, spark.createDataFrame(x, LABELS))) for x in (labels, flipped))
    pairs = zip(*(sorted((r["doc_id"], r["score"]) for r in s.collect()) for s in (a, b)))
    assert all(i == j and abs(p - q) < 1e-4 for (i, p), (j, q) in pairs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op12_toxicity(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    test = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(test) > 80 and sum(a == b for a, b in test) >= 0.9 * len(test)
    assert sum(a == 0 and b == 1 for a, b in test) <= 1


def test_minimise_reaches_the_optimum():
    rng = np.random.default_rng(1)
    q = rng.normal(size=(6, 6))
    q = q @ q.T + np.eye(6)
    b = rng.normal(size=6)
    x = T.minimise(lambda x: (0.5 * x @ q @ x - b @ x + 100, q @ x - b), np.zeros(6), steps=200, tolerance=1e-15)
    assert np.allclose(x, np.linalg.solve(q, b), atol=1e-5)


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, 1)], [(1, None), (None, 1), (3, 7)], [(1, 1), (1, 0), (4, 1), (8, 0), (9, 0), (6, 1)]])
def test_odd_tables(spark, labels):
    docs = clashing(awkward(spark))
    model = T.fit_toxicity(docs, spark.createDataFrame(labels, LABELS))
    got = T.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (2, 3, 5)}
    assert len(blank) == 1 and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    if not any(y in (0, 1) and i is not None for i, y in labels):
        assert {r["score"] for r in got} == {0.5}
    assert T.score_toxicity(empty(spark), model).count() == 0
    assert not T.fit_toxicity(empty(spark), spark.createDataFrame([(1, 1)], LABELS)).weights.any()


def test_the_end_of_a_long_text_counts(spark):
    head = "calm words go on and on " * 20_000
    rows = [(i, "some text here " + ("utter moron" if i % 2 else "fine thing") + f" {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit_toxicity(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], LABELS))
    long = spark.createDataFrame([(1, head), (2, head + "utter moron")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in T.score_toxicity(long, model).collect()}
    assert scores[2] > scores[1] + 0.2
