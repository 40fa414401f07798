"""Draws and repeated folds against plain versions; what their plans read."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from equigroup.operators import split


def md5(v, seed):
    return hashlib.md5(f"{v}|{seed}".encode()).hexdigest()


def test_draws_are_the_rows_at_their_positions(spark):
    df = spark.range(5000).selectExpr("id", "id * 2 AS v").repartition(3)
    got = {r["draw"]: (r["id"], r["v"]) for r in split.bootstrap_draw(df, "id", 300, 7).collect()}
    order = sorted(range(5000), key=lambda i: md5(i, 7))
    want = {i: order[int(md5(i, 7)[:8], 16) % 5000] for i in range(300)}
    assert got == {i: (v, 2 * v) for i, v in want.items()}
    assert split.bootstrap_draw(df.where("id < 0"), "id", 10).count() == 0
    assert split.bootstrap_draw(df.where("id = 4"), "id", 10).count() == 10


def test_draws_read_only_the_buckets_they_hit(spark):
    plan = split.bootstrap_draw(spark.range(5000), "id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Window"):]  # rows are cut to the buckets below the numbering


def test_fold_arrays(spark):
    df = spark.range(203).selectExpr("id", "cast(id % 3 as int) AS y", "'x' AS repeat_me")
    rows = split.repeated_folds(df, "y", "id", 4, 3, 42).collect()
    assert len(rows) == 203 and all(len(r["folds"]) == 3 for r in rows)
    for rep in range(3):
        for y in range(3):
            own = sorted((i for i in range(203) if i % 3 == y), key=lambda i: md5(i, 42 + rep))
            assert {r["id"]: r["folds"][rep] for r in rows if r["y"] == y} == {i: n % 4 for n, i in enumerate(own)}
    long = split.repeated_stratified_kfold(df, "y", "id", 4, 3, 42)
    assert long.columns == ["id", "y", "repeat_me", "repeat", "fold"]
    assert Counter(r["repeat"] for r in long.collect()) == {0: 203, 1: 203, 2: 203}
    assert {(r["id"], r["repeat"]): r["fold"] for r in long.collect()} == {(r["id"], i): f for r in rows for i, f in enumerate(r["folds"])}
