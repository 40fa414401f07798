import pytest
from pyspark.sql import functions as F

from equigroup.operators import attribution as A


def test_decompose_golden(spark):
    phi = spark.createDataFrame([(1, 1, 0, 0, 1.0), (1, 1, 0, 1, 2.0)],
                                "k int, class int, group_id int, dim int, phi double")
    dec = spark.createDataFrame([(0, 0, "x1", 1.0), (0, 0, "x2", 0.0), (0, 1, "x1", 3.0), (0, 1, "x2", 0.0)],
                                "group_id int, dim int, feature string, w double")
    out = {r["feature"]: r["phi"] for r in A.decompose(phi, dec, "k").collect()}
    assert out["x1"] == pytest.approx(1.75)
    assert out["x2"] == pytest.approx(0.0)


def test_percentile_range_golden(spark):
    d = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate([1, 2, 3, 4, 100])],
                              "k int, feature string, phi double")
    r = A.feature_ranges(d, 5, 95).first()
    assert r["range"] == pytest.approx(79.6)


def test_linear_attribution_sums_to_output_gap(spark):
    d = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "k int, a double, b double")
    coefs = {1: {"a": 0.5, "b": -2.0}}
    attr = A.linear_attribution(d, "k", coefs)
    out = A.linear_output(d, coefs).select("k", "f_1")
    mean_out = out.agg(F.avg("f_1")).first()[0]
    j = attr.groupBy("k").agg(F.sum("phi").alias("s")).join(out, "k").collect()
    for r in j:
        assert r["s"] == pytest.approx(r["f_1"] - mean_out, abs=1e-9)


def test_shapley_sampling_efficiency(spark):
    from equigroup.operators import shapley
    d = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(12)], "k int, a double, b double")
    bg = [[1.0, 1.0], [3.0, 0.0]]

    def model(df):  # a non-linear scorer written as column expressions
        return df.withColumn("p1", F.col("a") * F.col("b") + F.col("a"))

    phi = shapley.shapley_sampling(model, d, "k", ["a", "b"], bg, n_permutations=3)
    tot = phi.groupBy("k").agg(F.sum("phi").alias("s"))
    fx = model(d).select("k", "p1")
    fb = sum(a * b + a for a, b in bg) / len(bg)
    for r in tot.join(fx, "k").collect():
        assert r["s"] == pytest.approx(r["p1"] - fb, abs=1e-9)
