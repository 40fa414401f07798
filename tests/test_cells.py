"""Block counting of pair cells against a plain count."""

import random
from collections import Counter

import pytest

from equigroup.functions import cells
from equigroup.operators import info


def plain(rows, names):
    out = Counter()
    for s, t, *v in rows:
        for a in range(len(names)):
            if v[a] is not None:
                out[(s, a, -1, v[a], 0, 0)] += 1
            for b in range(a + 1, len(names)):
                if v[a] is not None and v[b] is not None and t is not None:
                    out[(s, a, b, v[a], v[b], t)] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"DENSE": 0}, {"CELLS": 40}, {"VALUES": 260, "DENSE": 10}])
def test_against_a_plain_count(spark, monkeypatch, limits):
    """Many batches, flushes on the way, dictionaries that start anew, nulls."""
    for k, v in limits.items():
        monkeypatch.setattr(cells, k, v)
    r = random.Random(3)
    rows = [(r.choice(["u", "v", None]), r.choice([0, 1, None]), r.randrange(4), r.choice([None, 5, 6]), i if i % 3 else None, None)
            for i in range(700)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "s string, t long, a long, b long, c long, d long").repartition(2)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(info, "symbol_sql", lambda name, kind: name)  # symbols are the values themselves
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = info.cell_counts(df, names, "t", "s").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {(x["s"], x["a"], x["b"], x["x"], x["y"], x["z"]): x["n"] for x in got} == plain(rows, names)


def test_no_rows_and_no_target(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a long, b long")
    got = {(x["a"], x["b"]): x["n"] for x in info.cell_counts(df, ["a", "b"], None).collect()}
    assert got == {(0, -1): 2, (1, -1): 1}
    assert info.cell_counts(df.where("a > 5"), ["a", "b"], "a").count() == 0
