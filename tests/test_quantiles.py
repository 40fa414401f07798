"""Order statistics by narrowing ranges against sorted lists."""

import math
import random

import pytest

from equigroup.functions import quantiles as Q
from equigroup.operators import metrics as V


def plain(values, q):
    v = sorted(values)
    h = q * (len(v) - 1)
    lo, hi = v[math.floor(h)], v[math.ceil(h)]
    return lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)


@pytest.mark.parametrize("cell, bins", [(10_000, 1024), (3, 5)])
def test_against_sorted_lists(spark, monkeypatch, cell, bins):
    """Many narrowing passes: ties, outliers of every size, nulls, a null group."""
    monkeypatch.setattr(Q, "CELL", cell)
    monkeypatch.setattr(Q, "BINS", bins)
    r = random.Random(cell + bins)
    rows = [("a", r.gauss(0, 1)) for _ in range(60)] + [("b", float(r.randrange(3))) for _ in range(60)] + [("c", 5.0)]
    rows += [(None, 10.0 ** r.randrange(-8, 8)) for _ in range(40)] + [("a", None), ("d", None), ("b", -0.0)]
    rows += [("e", v) for v in (1.7e308, -1.7e308, 0.0, 1.0, math.inf, -math.inf, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(x["k"], x["q"]): x["value"] for x in Q.percentiles(df, ["k"], "v", qs).collect()}
    values = {k: [v for g, v in rows if g == k and v is not None] for k in ("a", "b", "c", None, "e")}
    assert len(got) == 5 * len(values)
    for (k, q), value in got.items():
        want = plain(values[k], q)
        assert value == want or value == pytest.approx(want, rel=1e-12) or (math.isnan(value) and math.isnan(want))


def test_no_group_and_no_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert [(r["q"], r["value"]) for r in Q.percentiles(df, [], "v", [0.25]).collect()] == [(0.25, 25.0)]
    assert Q.percentiles(df.where("v < 0"), [], "v", [0.5]).count() == 0


def test_rows_without_truth_or_prediction_are_no_class(spark):
    d = spark.createDataFrame([(1, 1), (0, 0), (None, 1), (1, 1), (0, None)], "y int, p int")
    got = V.macro_scores(d, "y", "p").first()
    assert got["macro_f1"] == got["macro_precision"] == got["macro_recall"] == 1.0
