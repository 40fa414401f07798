import pytest
from pyspark.sql import functions as F

from equigroup import cohorts as C
from equigroup.operators import prep, split
from equigroup.spec import ORD_SPEC


def test_stratified_folds_balanced(spark, sf_small):
    d = C.c_doc(spark, sf_small)
    f = split.stratified_kfold(d, "quality", "doc_id", 5)
    cnt = f.groupBy("quality", "fold").count().collect()
    by = {}
    for r in cnt:
        by.setdefault(r["quality"], []).append(r["count"])
    for sizes in by.values():
        assert max(sizes) - min(sizes) <= 1
    assert f.count() == d.count()


def test_ranked_positions_exact(spark):
    from equigroup.functions.hashing import key_hash
    from equigroup.functions.ordering import hash_bucket, ranked
    d = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    r = ranked(d.withColumn("h", key_hash("id")), ["g"], ["h"], hash_bucket("h"), out="pos").toPandas()
    for _, grp in r.groupby("g"):
        assert sorted(grp["pos"]) == list(range(len(grp)))
        assert list(grp.sort_values("h")["pos"]) == list(range(len(grp)))


def test_test_draw_and_disjoint(spark, sf_small):
    raw = C.c_na(spark, sf_small)
    test = split.draw_test_from_clean(raw, prep.drop_null_rows(raw), "o_orderkey")
    n_raw = raw.count()
    assert test.count() == round(0.2 * n_raw)
    train = split.train_minus_test(raw, test, "o_orderkey")
    assert split.overlap_count(train, test, "o_orderkey").first()["n_overlap"] == 0
    assert train.count() + test.count() == n_raw


def test_zscore_population_std(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    z = [r["x"] for r in prep.zscore(d, ["x"]).collect()]
    assert sum(z) == pytest.approx(0.0, abs=1e-12)
    assert sum(v * v for v in z) / 4 == pytest.approx(1.0)
    c = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["x"] for r in prep.zscore(c, ["x"]).collect()] == [0.0, 0.0]


def test_ordinal_unknown_raises(spark):
    d = spark.createDataFrame([("a",), ("zzz",)], "c string")
    with pytest.raises(Exception):
        prep.ordinal_code(d, "c", ["a", "b"]).collect()
    t = prep.ordinal_code(d, "c", ["a", "b"], is_target=True).collect()
    assert [r["c"] for r in t] == [0, -1]


def test_encode_cohort_shapes(spark, sf_small):
    e = prep.encode_cohort(C.c_ord(spark, sf_small), ORD_SPEC)
    assert e.columns[-1] == "o_orderstatus"
    assert "c_mktsegment_BUILDING" in e.columns and "c_mktsegment" not in e.columns
    assert e.filter(F.col("o_orderpriority").isNull()).count() == 0


def test_null_audit(spark, sf_small):
    row = prep.null_audit(C.c_na(spark, sf_small)).first().asDict()
    assert row["c_mktsegment"] > 0 and row["o_orderkey"] == 0


def test_label_code_ranks_all_values(spark):
    rows = [(i, f"Customer#{(i * 7919) % 500:09d}") for i in range(2000)] + [(5000, None)]
    d = spark.createDataFrame(rows, "k int, c string")
    a = {r["k"]: r["c"] for r in prep.label_code(d, "c").collect()}
    b = {r["k"]: r["c"] for r in prep.label_code(d, "c", prep.fit_categories(d, "c")).collect()}
    assert a == b and a[5000] is None and len(a) == 2001
    assert sorted({v for v in a.values() if v is not None}) == list(range(500))


def test_more_categories_than_a_plan_holds_is_an_error(spark):
    with pytest.raises(ValueError):
        prep.fit_categories(spark.range(20), "id", most=10)


def test_null_labels_are_a_class_of_their_own(spark):
    d = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "k int, y int")
    folds = split.stratified_kfold(d, "y", "k", 5).collect()
    assert len(folds) == 40
    per = {}
    for r in folds:
        per.setdefault((r["y"], r["fold"]), []).append(r)
    assert len([g for g in per if g[0] is None]) == 5 and {len(v) for g, v in per.items() if g[0] is None} == {2}
    assert split.stratified_holdout(d, "y", "k", 0.2).count() == 40
    assert split.repeated_stratified_kfold(d, "y", "k", 5, 3).count() == 120
