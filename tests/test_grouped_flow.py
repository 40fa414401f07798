"""The embedding as a pipeline stage, attribution modes, both experiment flows."""

import json
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from equigroup.operators import embed, experiment, shapley
from equigroup.operators import models as M
from equigroup.operators.group_embedding import GroupEmbedding, GroupEmbeddingModel

GROUPS = {0: ["a", "b"], 1: ["c"]}


def table(spark, n=240):
    r = random.Random(8)
    rows = []
    for i in range(n):
        a = r.gauss(0, 1)
        rows.append((i, a, 2 * a + r.gauss(0, 0.05), float(i % 2), int(a + 0.5 * (i % 2) + r.gauss(0, 0.3) > 0.2)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def test_embedding_is_saved_and_loaded(spark, tmp_path):
    df = table(spark)
    fitted = GroupEmbedding(groups=json.dumps(GROUPS), keyCol="id", maxDim=2).fit(df)
    names = [n for n, _, _ in fitted.latents()]
    assert {g for _, g, _ in fitted.latents()} == {0, 1}
    inner = fitted.transform(df)
    assert inner.columns == [*df.columns, *names]
    classifier = M.fit(inner, "LogisticRegression", names, "y", {"C": 1.0})
    whole = PipelineModel(stages=[fitted, *classifier.stages])
    whole.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[0], GroupEmbeddingModel)
    a, b = ([(r["id"], r["prediction"], r["p1"]) for r in M.predict(m, df, "y").orderBy("id").collect()] for m in (whole, again))
    assert a == b and sum(p == r["y"] for (_, p, _), r in zip(a, df.orderBy("id").collect())) > 0.8 * len(a)
    with pytest.raises(Exception):
        M.predict(whole, df.withColumn("a", F.lit(None).cast("double")), "y").collect()
    # the stage's expressions are those of the table-driven encoder
    w = json.loads(fitted.getOrDefault(fitted.weights))
    moments = spark.createDataFrame([(f, m, s) for f, (m, s) in w["moments"].items()], "feature string, mean double, scale double")
    enc = [(g["group"], f, d, g["w1"][i][d]) for g in w["groups"] for i, f in enumerate(g["features"]) for d in range(g["width"])]
    bias = [(g["group"], d, g["b1"][d]) for g in w["groups"] for d in range(g["width"])]
    tables = embed.encode(df, moments, spark.createDataFrame(enc, "group_id int, feature string, dim int, w double"),
                          spark.createDataFrame(bias, "group_id int, dim int, b double"), keep=["id"])
    want = {r["id"]: tuple(r[n] for n in names) for r in tables.collect()}
    assert all(tuple(r[n] for n in names) == pytest.approx(want[r["id"]]) for r in inner.collect())


def test_modes(spark):
    """Two classes with opposite margins: aggregated is twice the absolute value."""
    df = table(spark, 12)
    score = lambda d: d.withColumn("scores", F.expr("array(a + c, -a - c)"))
    each = shapley.attribute(score, df, "id", ["a", "c"], [[0.0, 0.0], [1.0, 1.0]], 2)
    got = {(r["id"], r["class"], r["feature"]): r["phi"] for r in each.collect()}
    rows = {r["id"]: r for r in df.collect()}
    assert len(got) == 48 and all(v == pytest.approx((1 - 2 * c) * (rows[i][f] - 0.5)) for (i, c, f), v in got.items())
    whole = shapley.attribute(score, df, "id", ["a", "c"], [[0.0, 0.0], [1.0, 1.0]], 2, "aggregated")
    assert all(r["class"] is None and r["phi"] == pytest.approx(2 * abs(rows[r["id"]][r["feature"]] - 0.5)) for r in whole.collect())
    weighted = shapley.attribute(score, df, "id", ["a", "c"], [[0.0, 0.0]], 2, "aggregated", class_weights={0: 1.0, 1: 3.0})
    assert all(r["phi"] == pytest.approx(-2 * rows[r["id"]][r["feature"]]) for r in weighted.collect())
    with pytest.raises(ValueError):
        shapley.attribute(score, df, "id", ["a"], [[0.0]], 2, "both")


def test_both_flows_give_one_record(spark, tmp_path):
    df = table(spark)
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    own = {"sensitive": F.col("c") == 1.0, "protected": "c", "n_iter": 2, "cv_splits": 2}
    plain = experiment.run_experiment(train, test, "id", "LogisticRegression", ["a", "b", "c"], "y", mode="each_label", **own)
    grouped = experiment.run_grouped_experiment(train, test, "id", "LogisticRegression", GROUPS, "y", save_to=str(tmp_path / "g"), **own)
    assert plain.columns == grouped.columns and "Average distance from origin" in plain.columns
    for rec in (plain.collect(), grouped.collect()):
        assert len(rec) == 1 and rec[0]["Accuracy"] > 0.75 and rec[0]["Average distance from origin"] > 0
        assert rec[0]["range_max"] >= rec[0]["range_mean"] >= rec[0]["range_min"] >= 0
    assert isinstance(PipelineModel.load(str(tmp_path / "g")).stages[0], GroupEmbeddingModel)
