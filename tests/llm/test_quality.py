import math
import zlib

import numpy as np

from equigroup.llm import quality as q
from equigroup.llm import queries

from .helpers import CLASHES, awkward, clashing, empty

LABELS = "doc_id long, quality int"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_quality(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    test = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(test) > 50 and sum(a == b for a, b in test) >= 0.97 * len(test)
    assert sum(a == 1 and b == 0 for a, b in test) <= 1


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad ### ###") for i in range(80)], "doc_id long, text string")
    y = [(i, i % 2) for i in range(80)]
    flipped = [(i, 1 - v if held(i) else v) for i, v in y]
    a, b = (q.fit_quality(docs, spark.createDataFrame(x, LABELS), min_rows=2) for x in (y, flipped))
    assert a == b and a["weights"]


def test_scores_match_a_plain_version(spark):
    docs = spark.createDataFrame([(i, ("fine text of words " * 3 if i % 2 else "JUNK!! &&& ") + str(i % 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)
    model = q.fit_quality(docs, labels, min_rows=2)
    train = [(t, i % 2) for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if not held(i)]
    sets = [(q.features(t, q.Shapes()), y) for t, y in train]
    n1 = sum(y for _, y in sets)
    for f, (_, square) in model["weights"].items():
        c1, c0 = sum(f in s for s, y in sets if y), sum(f in s for s, y in sets if not y)
        ratio = math.log((c1 + 1) / (n1 + 2)) - math.log((c0 + 1) / (len(sets) - n1 + 2))
        assert abs(square - ratio * ratio) < 1e-9
    for r in q.score_quality(docs, model).collect():
        text = docs.where(f"doc_id = {r['doc_id']}").first()["text"] if r["doc_id"] < 4 else None
        if text is not None:
            hits = [model["weights"][f] for f in q.features(text, q.Shapes()) if f in model["weights"]]
            m = sum(h[0] for h in hits) / (math.sqrt(sum(h[1] for h in hits)) or 1) + model["intercept"]
            assert abs(r["score"] - 1 / (1 + math.exp(-(model["slope"] * m + model["offset"])))) < 1e-9


def test_dual_descent_meets_its_conditions():
    """At the optimum the primal and dual objectives meet."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 8))) for _ in range(120)]
    scale = rng.normal(0, 1, 30)
    y = np.where(np.array([scale[r].sum() + rng.normal(0, 0.5) for r in rows]) > 0, 1.0, -1.0)
    cost = np.full(120, 0.7)
    w, b = q.dual_descent(rows, y, scale, cost, epochs=3000)
    x = np.zeros((120, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / math.sqrt((scale[r] ** 2).sum())
        x[i, 30] = 1
    v = np.append(w, b)
    primal = 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    # v = sum alpha y x; the dual is sum(alpha) - |v|^2 / 2 and sum(alpha) = v.v + slackness terms at the optimum
    slack = np.maximum(0, 1 - y * (x @ v))
    dual = v @ v + (cost * slack).sum() - 0.5 * v @ v
    assert abs(primal - dual) < 1e-6 * max(1, primal)
    grad = np.zeros(31)
    for i in range(120):  # subgradient: v minus the pull of rows inside the margin may only be balanced by rows on it
        if y[i] * (x[i] @ v) < 1 - 1e-2:
            grad += cost[i] * y[i] * x[i]
    on = [i for i in range(120) if abs(y[i] * (x[i] @ v) - 1) <= 1e-2]
    rest, *_ = np.linalg.lstsq((x[on] * y[on, None]).T, v - grad, rcond=None) if on else (np.zeros(0),)
    assert np.abs((x[on] * y[on, None]).T @ rest - (v - grad)).max() < 1e-2 if on else np.abs(v - grad).max() < 1e-2


def test_odd_tables(spark):
    docs = clashing(awkward(spark))
    n = docs.count()
    for labels in ([], [(1, 1), (3, 1)], [(1, None), (None, 1), (3, 7)], [(1, 1), (1, 0), (4, 1), (8, 0), (9, 0)]):
        model = q.fit_quality(docs, spark.createDataFrame(labels, LABELS), min_rows=1)
        got = q.score_quality(docs, model).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    none = q.fit_quality(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in q.score_quality(docs, none).collect()} == {0.5}
    assert q.score_quality(empty(spark), none).count() == 0 and q.keep_good(docs, none).count() == 0
    kept = q.keep_good(docs, none, threshold=0.5)
    assert kept.columns == docs.columns and kept.count() == n and all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHES)
    assert q.fit_quality(empty(spark), spark.createDataFrame([(1, 1)], LABELS))["weights"] == {}


def test_shapes():
    assert [q.shape(w) for w in ("Word", "WORD!!", "abc123", "é$$$", "|", "x" * 99)] == ["Aa", "A!!", "a0", "a$$$", "|", "a"]
    assert ("a", "=", "=") in q.features("it it it it it", q.Shapes())


def test_whole_long_words_count():
    """What comes after the first characters of a word without blanks counts."""
    shapes = q.Shapes()
    head = "ab1-" * 30
    a, b = q.features(head + "你好" * 40 + "!?" * 20, shapes), q.features(head + "zq" * 40 + "##" * 20, shapes)
    assert {"\n你好", "\n!?"} <= a and {"\nzq", "\n##"} <= b and not {"\n你好", "\nzq"} & (a & b)
    assert {f for f in a if isinstance(f, tuple)} != {f for f in b if isinstance(f, tuple)}
    assert "".join(shapes[head]) == q.shape(head) == "a0-" * 30 and len(shapes[head]) == 8


def test_long_words_change_the_score(spark):
    head = "x1" * 60
    docs = spark.createDataFrame([(i, f"{head}{'好的' * 9 if i % 2 else '#!' * 9}{i}") for i in range(80)], "doc_id long, text string")
    model = q.fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], LABELS), min_rows=2)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in q.score_quality(docs, model).collect())
