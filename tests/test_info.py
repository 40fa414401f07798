import pytest
from pyspark.sql import functions as F

from equigroup.operators import info


def _xor(spark, const_z=False):
    rows = [(x, y, 0 if const_z else x ^ y) for x in (0, 1) for y in (0, 1)]
    return spark.createDataFrame(rows, "x int, y int, z int")


def test_entropy_and_cmi_xor(spark):
    d = _xor(spark)
    h = {r["feature"]: r["entropy"] for r in info.entropy(d, ["x", "y"]).collect()}
    assert h["x"] == pytest.approx(1.0) and h["y"] == pytest.approx(1.0)
    m = info.dissimilarity(d, ["x", "y"], "z", with_parts=True).first()
    assert m["cmi"] == pytest.approx(1.0, abs=1e-9)
    assert m["dissimilarity"] == pytest.approx(0.5, abs=1e-9)


def test_cmi_constant_target(spark):
    m = info.dissimilarity(_xor(spark, const_z=True), ["x", "y"], "z", with_parts=True).first()
    assert m["cmi"] == pytest.approx(0.0, abs=1e-12)
    assert m["dissimilarity"] == pytest.approx(1.0, abs=1e-9)


def test_cmi_bounds_and_nulls(spark):
    rows = [(i % 3, (i * 7) % 5 if i % 11 else None, i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "a int, b int, t int")
    m = info.dissimilarity(d, ["a", "b"], "t", with_parts=True).first()
    assert 0.0 <= m["cmi"] <= min(m["h_i"], m["h_j"]) + 1e-9
    # pairwise null drop: the pair count equals rows where b is set
    n = info.conditional_mutual_information(d, ["a", "b"], "t").first()["n"]
    assert n == d.filter(F.col("b").isNotNull()).count()


def test_gram_centring_example(spark):
    from tests.conftest import EXAMPLE, EXAMPLE_NAMES, matrix_df
    g = info.centred_gram(matrix_df(spark, EXAMPLE_NAMES, EXAMPLE))
    diag = {r["fi"]: r["gram"] for r in g.filter(F.col("fi") == F.col("fj")).collect()}
    assert diag["A"] == pytest.approx(0.198438, abs=1e-6)
    assert diag["B"] == pytest.approx(0.157187, abs=1e-6)
    assert diag["C"] == pytest.approx(0.211562, abs=1e-6)
    assert diag["D"] == pytest.approx(0.129063, abs=1e-6)
    spec = info.gram_spectrum(g).orderBy("component").collect()
    assert not spec[0]["is_euclidean"]
    assert spec[0]["min_eigenvalue"] == pytest.approx(-6.9e-5, abs=1e-6)
    assert [round(r["explained"], 6) for r in spec] == [0.973149, 0.026851]
