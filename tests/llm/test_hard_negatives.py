"""Hard negatives against brute force in plain Python."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from equigroup.llm import hard_negatives as H
from equigroup.llm import queries

from .helpers import CLASHES

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    fine = [(i, y, [math.floor(scale * c) for c in v]) for i, y, v in rows
            if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for i, y, x in fine:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, x)), (y, x))
    out = []
    for a, (y, x) in anchors.items():
        scored = [(-sum(p * q for p, q in zip(x, z)), i, label) for i, label, z in fine if i != a and len(z) == len(x)]
        best = sorted((s, i) for s, i, label in scored if label == y)[:positives]
        for ps, pid in best:
            hits = sorted((s, i) for s, i, label in scored if label != y and low * -ps <= 100 * -s <= high * -ps)[:negatives]
            out += [(a, pid, r, i, -ps, -s) for r, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(n, d, labels, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, r.randrange(labels), [round(r.gauss(0.4, spread), 3) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("n, d, labels, spread, block", [(150, 3, 3, 1.0, 4), (150, 6, 2, 0.2, 2048), (60, 1, 4, 0.5, 3)])
def test_against_brute_force(spark, monkeypatch, n, d, labels, spread, block):
    monkeypatch.setattr(H, "CELLS", 70)  # many slices a task
    rows = vectors(n, d, labels, n + d, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = plain([tuple(r) for r in df.collect()], lambda i: i % 10 == 0)
    assert expected and got(H.mine_hard_negatives(df, F.col("id") % 10 == 0, block=block)) == expected


def test_ties_and_copies(spark):
    """A third of the rows are one vector under two labels; ids repeat too."""
    rows = vectors(60, 2, 3, 7) + [(i, i % 2, [0.5, 0.5]) for i in range(100, 140)] + [(105, 0, [0.5, 0.5]), (100, 1, [0.5, 0.25])] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    expected = plain([tuple(r) for r in df.collect()], lambda i: i % 5 == 0)
    assert got(H.mine_hard_negatives(df, F.col("id") % 5 == 0)) == expected


def test_windows_and_counts_as_parameters(spark):
    df = spark.createDataFrame(vectors(120, 4, 3, 3, 0.3), SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    found = H.mine_hard_negatives(df, F.col("id") < 8, positives=2, negatives=3, low=50, high=95)
    assert got(found) == plain(rows, lambda i: i < 8, 2, 3, 50, 95)


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got(queries.op11_hard_negatives(spark, sf)) == sorted(duckdb.sql(H.ORACLE).fetchall())


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [0.9, 0.9]), (3, None, [1.0, 1.0]), (4, 2, None), (None, 2, [1.0, 1.0]),
            (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, []), (9, 2, [1.0]), (10, 2, [3e38, 1.0]),
            (20, 3, [-1.0, -1.0]), (21, 3, [1.0, 0.5]), (30, 9, [1.0]), (2, 2, [0.9, 0.9])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ["id", "x", "key", "rank", *CLASHES] if c not in ("label",)])
    fine = [r for r in rows if r[0] != 10]  # scores with such components would leave a long
    seen = got(H.mine_hard_negatives(df, F.col("id") % 10 == 0))
    single = [(i, y, None if v is None else [None if c is None else c for c in v]) for i, y, v in fine]
    as_float = [tuple(r) for r in spark.createDataFrame(single, SCHEMA).collect()]
    assert seen == plain(as_float, lambda i: i % 10 == 0) and {r[0] for r in seen} == {0}
    none = spark.createDataFrame([], SCHEMA)
    assert H.mine_hard_negatives(none, F.col("id") % 100 == 0).count() == 0
    assert H.mine_hard_negatives(none, F.col("id") % 100 == 0).columns == [c.split()[0] for c in H.RESULT.split(", ")]


def test_large_components_are_exact(spark):
    big = 2.0 ** 17
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 0.75]), (2, 2, [big, 0.5]), (3, 2, [big, 0.4921875]), (4, 2, [big, 0.25])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(H.mine_hard_negatives(df, F.col("id") == 0)) == plain(rows, lambda i: i == 0)
