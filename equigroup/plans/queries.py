"""Named queries, one per operator id of the inventory. Each reads the given
tables through a cohort and returns a DataFrame (doubles rounded to 6)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from equigroup import cohorts as C
from equigroup.operators import info
from equigroup.plans.registry import QUERIES, query
from equigroup.session import checkpoint_dir, materialize


# ---------------------------------------------------------------- 2.6 info
@query("i1_entropy")
def i1_entropy(spark, sf):
    return info.entropy(C.c_line(spark, sf), C.LINE_FEATURES)


@query("i2_cmi")
def i2_cmi(spark, sf):
    return info.conditional_mutual_information(C.c_line(spark, sf), C.LINE_FEATURES, C.LINE_TARGET) \
        .select("fi", "fj", "cmi")


def line_matrix(spark, sf):
    return info.dissimilarity(C.c_line(spark, sf), C.LINE_FEATURES, C.LINE_TARGET)


@query("i3_dissimilarity")
def i3_dissimilarity(spark, sf):
    return line_matrix(spark, sf)


@query("i4_gram_centring")
def i4_gram_centring(spark, sf):
    return info.centred_gram(materialize(line_matrix(spark, sf)))


@query("i4_gram_spectrum")
def i4_gram_spectrum(spark, sf):
    return info.gram_spectrum(info.centred_gram(materialize(line_matrix(spark, sf))))


def all_queries():
    return dict(QUERIES)


# ---------------------------------------------------------------- 2.1/2.2 projections
from equigroup.functions.columns import privileged  # noqa: E402
from equigroup.operators import flow, prep, split  # noqa: E402
from equigroup.sources.tables import read_table  # noqa: E402
from equigroup.spec import ORD_SPEC  # noqa: E402

PRIORITY_LEVELS = ORD_SPEC.ordinal["o_orderpriority"]


@query("s1_load_cohort")
def s1_load_cohort(spark, sf):
    return C.c_ord(spark, sf)


@query("p1_numeric_columns")
def p1_numeric_columns(spark, sf):
    return prep.select_numeric(C.c_ord(spark, sf), exclude=["n_regionkey"])


@query("p2_drop_column")
def p2_drop_column(spark, sf):
    return C.c_ord(spark, sf).drop("c_mktsegment")


@query("p3_drop_null_rows")
def p3_drop_null_rows(spark, sf):
    return prep.drop_null_rows(C.c_na(spark, sf))


@query("p4_null_split")
def p4_null_split(spark, sf):
    missing, known = prep.split_by_null(C.c_na(spark, sf), "c_mktsegment")
    return (missing.select("o_orderkey", F.lit("missing").alias("part"))
            .unionByName(known.select("o_orderkey", F.lit("known").alias("part"))))


@query("p5_target_last")
def p5_target_last(spark, sf):
    return prep.target_last(C.c_ord(spark, sf), "o_orderstatus")


@query("p6_strip_prefix_int")
def p6_strip_prefix_int(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", prep.strip_prefix_int("c_name", 9).alias("c_id"))


@query("p7_null_audit")
def p7_null_audit(spark, sf):
    return prep.null_audit(C.c_na(spark, sf))


@query("p8_privileged_mask")
def p8_privileged_mask(spark, sf):
    d = C.c_pred(spark, sf)
    return d.select("doc_id", "lang", privileged(F.col("lang"), "en").alias("privileged"))


@query("p11_non_constant_features")
def p11_non_constant_features(spark, sf):
    return prep.non_constant_features(C.c_emb(spark, sf), C.EMB_FEATURES)


@query("p13_deviation_filter")
def p13_deviation_filter(spark, sf):
    d = C.c_pred(spark, sf)
    return prep.deviation_filter(d, "p1", privileged(F.col("lang"), "en"), 0.05) \
        .select("doc_id", "lang", "p1", "deviation")


# ---------------------------------------------------------------- 2.5 encoding
@query("e1_one_hot")
def e1_one_hot(spark, sf):
    return prep.one_hot(C.c_ord(spark, sf), "c_mktsegment")


@query("e2_label_code")
def e2_label_code(spark, sf):
    return prep.label_code(C.c_ord(spark, sf), "o_orderstatus")


@query("e3_ordinal_code")
def e3_ordinal_code(spark, sf):
    return prep.ordinal_code(C.c_ord(spark, sf), "o_orderpriority", PRIORITY_LEVELS)


@query("e4_ordinal_target")
def e4_ordinal_target(spark, sf):
    d = C.c_ord(spark, sf).select("o_orderkey", "o_orderstatus")
    return prep.ordinal_code(d, "o_orderstatus", ["F", "O"], is_target=True)


@query("e5_encode_list")
def e5_encode_list(spark, sf):
    return prep.encode_list(C.c_ord(spark, sf), ["c_mktsegment", "o_orderstatus!"])


@query("e6_cohort_spec")
def e6_cohort_spec(spark, sf):
    return prep.encode_cohort(C.c_ord(spark, sf), ORD_SPEC)


@query("e7_zscore")
def e7_zscore(spark, sf):
    d = C.c_ord(spark, sf).select("o_orderkey", "o_totalprice", "c_acctbal")
    return prep.zscore(d, ["o_totalprice", "c_acctbal"])


@query("e10_prepare")
def e10_prepare(spark, sf):
    train, test = flow.prepare(C.c_na(spark, sf), ORD_SPEC)
    return flow.split_summary(train, test, "o_orderkey")


# ---------------------------------------------------------------- 2.3 splits
def _m1_parts(spark, sf):
    raw = C.c_na(spark, sf)
    test = split.draw_test_from_clean(raw, prep.drop_null_rows(raw), "o_orderkey")
    return raw, test


@query("m1_test_draw")
def m1_test_draw(spark, sf):
    return _m1_parts(spark, sf)[1].select("o_orderkey")


@query("m2_train_minus_test")
def m2_train_minus_test(spark, sf):
    raw, test = _m1_parts(spark, sf)
    return split.train_minus_test(raw, test, "o_orderkey").select("o_orderkey")


@query("m3_disjoint_check")
def m3_disjoint_check(spark, sf):
    raw, test = _m1_parts(spark, sf)
    return split.overlap_count(split.train_minus_test(raw, test, "o_orderkey"), test, "o_orderkey")


@query("m4_stratified_holdout")
def m4_stratified_holdout(spark, sf):
    return split.stratified_holdout(C.c_doc(spark, sf), "quality", "doc_id", 0.15) \
        .select("doc_id", "quality", "is_test")


@query("m5_random_holdout")
def m5_random_holdout(spark, sf):
    return split.random_holdout(C.all_doc(spark, sf), "doc_id", 0.2).select("doc_id", "is_test")


@query("m6_stratified_kfold")
def m6_stratified_kfold(spark, sf):
    return split.stratified_kfold(C.c_doc(spark, sf), "quality", "doc_id", 5).select("doc_id", "quality", "fold")


@query("m7_repeated_kfold")
def m7_repeated_kfold(spark, sf):
    return split.repeated_stratified_kfold(C.c_doc(spark, sf), "quality", "doc_id", 5, 10) \
        .select("doc_id", "repeat", "fold")


@query("m8_bootstrap_draw")
def m8_bootstrap_draw(spark, sf):
    return split.bootstrap_draw(C.all_doc(spark, sf), "doc_id", 300).select("draw", "doc_id")


# ---------------------------------------------------------------- 2.4 joins
@query("j1_key_join")
def j1_key_join(spark, sf):
    return C.c_doc(spark, sf)


@query("j2_anti_join")
def j2_anti_join(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j3_vertical_concat")
def j3_vertical_concat(spark, sf):
    d = split.stratified_holdout(C.c_doc(spark, sf), "quality", "doc_id", 0.15)
    train = d.filter(~F.col("is_test")).select("doc_id", "quality", F.lit("train").alias("part"))
    val = d.filter(F.col("is_test")).select("doc_id", "quality", F.lit("validation").alias("part"))
    return train.unionByName(val)


def two_populations(spark, sf):
    d = C.all_doc(spark, sf)
    emp = d.select("doc_id", "n_chars", "source", F.lit(0).alias("origin"))
    rem = d.filter(F.col("lang") != "en").select("doc_id", "n_chars", "source", F.lit(1).alias("origin"))
    return emp, rem


@query("j4_origin_union")
def j4_origin_union(spark, sf):
    emp, rem = two_populations(spark, sf)
    return emp.unionByName(rem)


# ---------------------------------------------------------------- 2.7 grouping
from equigroup.operators import grouping as G  # noqa: E402
from equigroup.operators import moments  # noqa: E402

GROUPS_K = 5


def emb_matrix(spark, sf):
    """Dissimilarity of the 64 binned embedding features given the label."""
    return materialize(info.dissimilarity(C.c_emb_binned(spark, sf), C.EMB_FEATURES, "label"))


def emb_random_assignment(spark, sf):
    features = G.columns_of(C.c_emb(spark, sf).select(*C.EMB_FEATURES))
    return emb_matrix(spark, sf), G.random_grouping(features, GROUPS_K)


@query("i3_dissimilarity_wide")
def i3_dissimilarity_wide(spark, sf):
    return emb_matrix(spark, sf)


@query("g1_random_grouping")
def g1_random_grouping(spark, sf):
    return G.random_grouping(G.columns_of(C.c_emb(spark, sf).select(*C.EMB_FEATURES)), GROUPS_K)


@query("g3_diversity")
def g3_diversity(spark, sf):
    m, a = emb_random_assignment(spark, sf)
    return G.group_quality(a, m).select("group_id", "n_features", "diversity")


@query("g4_dispersion")
def g4_dispersion(spark, sf):
    m, a = emb_random_assignment(spark, sf)
    return G.group_quality(a, m).select("group_id", "dispersion")


@query("g5_score")
def g5_score(spark, sf):
    m, a = emb_random_assignment(spark, sf)
    return G.grouping_score(G.group_quality(a, m), 0.5, 0.5, k=GROUPS_K)


@query("g6_grouping_report")
def g6_grouping_report(spark, sf):
    m, a = emb_random_assignment(spark, sf)
    return G.grouping_report(G.group_quality(a, m), m, normalize=True)


@query("g11_k_sweep")
def g11_k_sweep(spark, sf):
    return G.k_sweep_random(emb_matrix(spark, sf), range(2, 11))


@query("g2_greedy_seeds")
def g2_greedy_seeds(spark, sf):
    return G.greedy_seeds(emb_matrix(spark, sf), GROUPS_K)


@query("g2_greedy_grouping")
def g2_greedy_grouping(spark, sf):
    return G.greedy_grouping(emb_matrix(spark, sf), [GROUPS_K], feature_order=C.EMB_FEATURES)


@query("g7_bicriterion")
def g7_bicriterion(spark, sf):
    return G.bicriterion_grouping(line_matrix(spark, sf), [2], restarts=10)


def emb_scaled(spark, sf):
    e = C.c_emb(spark, sf)
    return prep.zscore(e, C.EMB_FEATURES)


@query("g8_kplus")
def g8_kplus(spark, sf):
    z = emb_scaled(spark, sf)
    nc = [r[0] for r in prep.non_constant_features(z, C.EMB_FEATURES).select("feature").collect()]
    aug = G.augmented_gram(moments.feature_gram(z, nc), moments.skew_kurtosis(z, nc))
    return G.kplus_grouping(aug, [GROUPS_K])


@query("g9_feature_gram")
def g9_feature_gram(spark, sf):
    return moments.feature_gram(C.c_emb(spark, sf), C.EMB_FEATURES)


@query("g10_moments")
def g10_moments(spark, sf):
    return moments.skew_kurtosis(C.c_emb(spark, sf), C.EMB_FEATURES)


# ---------------------------------------------------------------- 2.10 metrics
from equigroup.operators import metrics as V  # noqa: E402


@query("v1_accuracy")
def v1_accuracy(spark, sf):
    return V.accuracy(C.c_pred(spark, sf), "y_true", "y_pred")


@query("v2_macro_f1")
def v2_macro_f1(spark, sf):
    return V.macro_scores(C.c_pred3(spark, sf), "y_true", "y_pred").select("macro_f1")


@query("v3_macro_precision")
def v3_macro_precision(spark, sf):
    return V.macro_scores(C.c_pred3(spark, sf), "y_true", "y_pred").select("macro_precision")


@query("v4_roc_auc")
def v4_roc_auc(spark, sf):
    return V.roc_auc(C.c_pred(spark, sf), "y_true", "p1")


@query("v5_metric_record")
def v5_metric_record(spark, sf):
    return V.metric_record(C.c_pred(spark, sf), "y_true", "y_pred", "p1", "LengthRule")


@query("v5_metric_record_nulls")
def v5_metric_record_nulls(spark, sf):
    """The record where every seventh truth and every eleventh prediction is missing."""
    d = C.c_pred3(spark, sf).selectExpr("IF(o_orderkey % 7 = 0, NULL, y_true) AS y_true", "IF(o_orderkey % 11 = 0, NULL, y_pred) AS y_pred",
                                        "cast(y_pred AS double) AS score")
    return V.metric_record(d, "y_true", "y_pred", "score", "PriceRule")


@query("v5_metric_record_multiclass")
def v5_metric_record_multiclass(spark, sf):
    d = C.c_pred3(spark, sf).withColumn("score", F.col("y_pred").cast("double"))
    return V.metric_record(d, "y_true", "y_pred", "score", "PriceRule")


# ---------------------------------------------------------------- 2.11 fairness
from equigroup.operators import fairness as FA  # noqa: E402


def _fair_pred(spark, sf):
    return C.c_pred(spark, sf), privileged(F.col("lang"), "en")


@query("f1_group_rates")
def f1_group_rates(spark, sf):
    d, p = _fair_pred(spark, sf)
    return FA.group_rates(d, "y_true", "y_pred", p).select("privileged", "tp", "fp", "tn", "fn", "tpr", "fpr",
                                                           "precision", "error_rate")


@query("f2_disparate_impact")
def f2_disparate_impact(spark, sf):
    d, p = _fair_pred(spark, sf)
    return FA.fairness_record(d, "y_true", "y_pred", p).select("Disparate Impact")


@query("f3_equal_opportunity")
def f3_equal_opportunity(spark, sf):
    d, p = _fair_pred(spark, sf)
    return FA.fairness_record(d, "y_true", "y_pred", p).select("Equal Opportunity")


@query("f4_equalized_odds")
def f4_equalized_odds(spark, sf):
    d, p = _fair_pred(spark, sf)
    return FA.fairness_record(d, "y_true", "y_pred", p).select("Equalized Odds")


@query("f5_predictive_parity")
def f5_predictive_parity(spark, sf):
    d, p = _fair_pred(spark, sf)
    return FA.fairness_record(d, "y_true", "y_pred", p).select("Predictive Parity")


@query("f6_n_sigma")
def f6_n_sigma(spark, sf):
    d, p = _fair_pred(spark, sf)
    return FA.fairness_record(d, "y_true", "y_pred", p).select("N-Sigma (ErrorRate)")


@query("f11_fairness_record_multiclass")
def f11_fairness_record_multiclass(spark, sf):
    d = C.c_pred3(spark, sf)
    return FA.fairness_record(d, "y_true", "y_pred", privileged(F.col("c_mktsegment"), "BUILDING"))


# ---------------------------------------------------------------- 2.12 attribution
from equigroup import fixed_weights as W  # noqa: E402
from equigroup.operators import attribution as A  # noqa: E402
from equigroup.operators import embed as B  # noqa: E402


def doc_features(spark, sf):
    """C_pred plus the model's inputs (n_chars, toxic, is_en) from one join.
    The result feeds several branches (rates, attributions, group means,
    fits), so it is materialized once instead of re-running the join."""
    d = C.c_doc(spark, sf)
    return materialize(d.select(
        "doc_id", "lang", F.col("quality").alias("y_true"),
        F.when(F.col("n_chars") > 1500, F.lit(1)).otherwise(F.lit(0)).alias("y_pred"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n_chars") - 1500) / F.lit(1000.0)))).alias("p1"),
        "n_chars", "toxic", F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("is_en")))


def doc_attribution(spark, sf):
    d = doc_features(spark, sf)
    return d, A.linear_attribution(d, "doc_id", {1: W.DOC_COEFS})


@query("f7_explanation_bias")
def f7_explanation_bias(spark, sf):
    d, attr = doc_attribution(spark, sf)
    return FA.explanation_bias(attr, d, "doc_id", privileged(F.col("lang"), "en"))


def _instance(spark, sf):
    d, attr = doc_attribution(spark, sf)
    prot = attr.filter((F.col("feature") == "is_en") & (F.col("class") == 1))
    return d, FA.instance_points(d, "doc_id", "p1", privileged(F.col("lang"), "en"), prot)


@query("f8_instance_bias")
def f8_instance_bias(spark, sf):
    return FA.instance_bias(_instance(spark, sf)[1])


@query("f8_quadrants")
def f8_quadrants(spark, sf):
    return FA.quadrant_counts(_instance(spark, sf)[1])


@query("f11_fairness_record")
def f11_fairness_record(spark, sf):
    d, pts = _instance(spark, sf)
    rec = FA.fairness_record(d, "y_true", "y_pred", privileged(F.col("lang"), "en"))
    return rec.crossJoin(FA.instance_bias(pts).select("Average distance from origin"))


def emb_attribution(spark, sf):
    coefs = {1: {f"f{i}": W.emb_coef(i) for i in range(64)}, 0: {f"f{i}": -W.emb_coef(i) for i in range(64)}}
    return A.linear_attribution(C.c_emb(spark, sf), "vec_id", coefs)


@query("a1_linear_attribution")
def a1_linear_attribution(spark, sf):
    return emb_attribution(spark, sf)


@query("a5_feature_ranges")
def a5_feature_ranges(spark, sf):
    return A.feature_ranges(emb_attribution(spark, sf), 5, 95, by=["class"])


@query("a5_feature_ranges_nulls")
def a5_feature_ranges_nulls(spark, sf):
    """Ranges where a fifth of the attributions is missing."""
    phi = emb_attribution(spark, sf).withColumn("phi", F.expr("IF(vec_id % 5 = 0, NULL, phi)"))
    return A.feature_ranges(phi, 10, 75, by=["class"])


@query("a5_range_stats")
def a5_range_stats(spark, sf):
    return A.range_stats(A.feature_ranges(emb_attribution(spark, sf), 5, 95, by=["class"]), by=["class"])


@query("a6_collapse_classes")
def a6_collapse_classes(spark, sf):
    return A.collapse_classes(emb_attribution(spark, sf), "vec_id")


@query("a8_importance_top")
def a8_importance_top(spark, sf):
    return A.importance(emb_attribution(spark, sf), top=10, by=["class"])


def emb_encoder_tables(spark):
    enc, eb, dec, db = [], [], [], []
    for i in range(64):
        g = W.emb_group_of(i)
        for d in range(W.emb_dims(g)):
            enc.append((g, f"f{i}", d, W.enc_w(g, i, d)))
            dec.append((g, d, f"f{i}", W.dec_w(g, d, i)))
        db.append((g, f"f{i}", 0.0))
    for g in range(W.EMB_GROUPS):
        for d in range(W.emb_dims(g)):
            eb.append((g, d, W.enc_b(g, d)))
    return (spark.createDataFrame(enc, "group_id int, feature string, dim int, w double"),
            spark.createDataFrame(eb, "group_id int, dim int, b double"),
            spark.createDataFrame(dec, "group_id int, dim int, feature string, w double"),
            spark.createDataFrame(db, "group_id int, feature string, b double"))


@query("b3_encode_latent")
def b3_encode_latent(spark, sf):
    e = C.c_emb(spark, sf)
    enc, eb, _, _ = emb_encoder_tables(spark)
    return B.encode(e, B.moments_table(e, C.EMB_FEATURES), enc, eb, keep=["vec_id"])


@query("b5_reconstruction_mse")
def b5_reconstruction_mse(spark, sf):
    e = C.c_emb(spark, sf)
    enc, eb, dec, db = emb_encoder_tables(spark)
    return B.reconstruction_mse(e, B.moments_table(e, C.EMB_FEATURES), enc, eb, dec, db)


@query("a4_decompose_latent")
def a4_decompose_latent(spark, sf):
    e = C.c_emb(spark, sf)
    enc, eb, dec, _ = emb_encoder_tables(spark)
    lat = B.encode(e, B.moments_table(e, C.EMB_FEATURES), enc, eb, keep=["vec_id"])
    coefs = {1: {B.latent_name(g, d, W.emb_dims(g)): W.latent_coef(g, d)
                 for g in range(W.EMB_GROUPS) for d in range(W.emb_dims(g))}}
    lphi = A.linear_attribution(lat, "vec_id", coefs)
    names = [(B.latent_name(g, d, W.emb_dims(g)), g, d) for g in range(W.EMB_GROUPS) for d in range(W.emb_dims(g))]
    lmap = spark.createDataFrame(names, "feature string, group_id int, dim int")
    lphi = lphi.join(F.broadcast(lmap), "feature").select("vec_id", "class", "group_id", "dim", "phi")
    return A.decompose(lphi, dec, "vec_id")


# ---------------------------------------------------------------- 2.13 run reporting
from equigroup.operators import reports as R  # noqa: E402
from equigroup.sources import runlog  # noqa: E402
from equigroup.vocab import BENCH_MODELS, FAIRNESS_KEYS, MODELS, PERFORMANCE_KEYS  # noqa: E402

SHORT_TO_LONG = {MODELS[t]: BENCH_MODELS[t] for t in MODELS}


def run_records(spark, sf):
    r = runlog.parse_performance_names(C.c_run(spark, sf))
    return r.filter(F.col("dataset").isNotNull()).select(
        "file_name", "dataset", "model", "grouping", F.col("acc").alias("Accuracy"),
        F.col("prec").alias("Precision"), F.col("f1").alias("F1-score"))


def fair_records(spark, sf):
    r = runlog.parse_fairness_names(C.c_fair_run(spark, sf))
    return r.filter(F.col("dataset").isNotNull()).select(
        "dataset", "model", "grouping", *[F.col(f"`{k}`") for k in FAIRNESS_KEYS])


@query("s3_parse_filename")
def s3_parse_filename(spark, sf):
    return run_records(spark, sf).select("file_name", "dataset", "model", "grouping")


@query("p9_canonical_names")
def p9_canonical_names(spark, sf):
    r = C.c_run(spark, sf)
    tok = F.regexp_extract(F.lower(F.col("file_name")), r"_(xgboost|randomforest|logisticregression|mlp|svm)_", 1)
    vocab = F.create_map(*[x for k, v in MODELS.items() for x in (F.lit(k), F.lit(v))])
    return r.select("file_name", tok.alias("model_token"), vocab[tok].alias("model"))


@query("p10_usable_mean")
def p10_usable_mean(spark, sf):
    from equigroup.functions.columns import usable
    return run_records(spark, sf).groupBy("dataset").agg(F.avg(usable(F.col("Accuracy"))).alias("mean_accuracy"))


@query("r1_run_counts")
def r1_run_counts(spark, sf):
    return R.run_counts(run_records(spark, sf))


def perf_report(spark, sf):
    return R.pivot_report(R.with_recall(run_records(spark, sf)), PERFORMANCE_KEYS)


@query("r2_performance_report")
def r2_performance_report(spark, sf):
    return perf_report(spark, sf)


@query("r3_fairness_report")
def r3_fairness_report(spark, sf):
    return R.pivot_report(fair_records(spark, sf), FAIRNESS_KEYS, eps=1e-8)


@query("r4_display_order")
def r4_display_order(spark, sf):
    return R.report_order(perf_report(spark, sf), PERFORMANCE_KEYS).select("metric", "grouping", "position")


@query("s7_report_format")
def s7_report_format(spark, sf):
    return R.format_report(perf_report(spark, sf))


def bc_precision(spark, sf):
    rec = run_records(spark, sf)
    vocab = F.create_map(*[x for k, v in SHORT_TO_LONG.items() for x in (F.lit(k), F.lit(v))])
    rec = rec.withColumn("model", vocab[F.col("model")])
    return R.dataset_model_means(rec, "Breast Cancer", "Precision")


@query("r5_dataset_model_means")
def r5_dataset_model_means(spark, sf):
    return bc_precision(spark, sf)


@query("r6_benchmark_compare")
def r6_benchmark_compare(spark, sf):
    return R.benchmark_compare(bc_precision(spark, sf), R.benchmark_table(spark))


@query("j8_benchmark_join")
def j8_benchmark_join(spark, sf):
    return R.benchmark_compare(bc_precision(spark, sf), R.benchmark_table(spark)) \
        .select("model", "grouping", "value_pct", "min", "mean", "max")


def scratch(spark, name):
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s2_run_tree")
def s2_run_tree(spark, sf):
    """One JSON run a file name of the log, every seventh broken or of another
    kind; written as a tree, read back by pattern, unreadable runs skipped."""
    runs = C.c_run(spark, sf).groupBy("file_name").agg(F.max("acc").alias("a"), F.max("prec").alias("p"), F.max("f1").alias("f"))
    number = F.conv(F.substring(F.md5("file_name"), 1, 4), 16, 10).cast("int") % 7
    record = F.to_json(F.array(F.struct(F.col("a").alias("Accuracy"), F.col("p").alias("Precision"), F.col("f").alias("F1-score"))))
    text = F.when(number == 0, F.lit('[{"Accuracy": ')).when(number == 1, F.lit("[]")).otherwise(record)
    root = scratch(spark, "runs")
    name = F.when(number == 2, F.concat("file_name", F.lit(".bak"))).otherwise(F.col("file_name"))
    runlog.save_run_folders(runs.select(name.alias("file_name"), text.alias("text")), root)
    rec = runlog.performance_records(runlog.read_run_folders(spark, root, "performance_metrics_*.json"))
    return rec.groupBy("dataset", "model", "grouping").agg(
        F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("skipped"),
        F.sum(F.when(F.col("ok"), F.col("Accuracy"))).alias("accuracy"), F.sum(F.when(F.col("ok"), F.col("F1-score"))).alias("f1"))


@query("s4_benchmark_csv")
def s4_benchmark_csv(spark, sf):
    """The benchmark written as CSV under longer headings, read back, compared."""
    path = scratch(spark, "benchmark")
    b = R.benchmark_table(spark)
    runlog.save_csv(b.select(F.col("model").alias("Model name"), F.col("min").alias("Min (%)"), F.lit("x").alias("note"),
                             F.col("mean").alias("Mean (%)"), F.col("max").alias("MAX")), path)
    return R.benchmark_compare(bc_precision(spark, sf), runlog.load_benchmark_csv(spark, path))


@query("s5_csv_sink")
def s5_csv_sink(spark, sf):
    path = scratch(spark, "report")
    report = perf_report(spark, sf)
    runlog.save_csv(report, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in report.schema.fields])


@query("s6_metric_json")
def s6_metric_json(spark, sf):
    """Records of three runs and of none appended to one JSON table, read back."""
    path = scratch(spark, "metrics")
    rec = materialize(run_records(spark, sf).select("dataset", "grouping", "model", "Accuracy", "F1-score"))
    for i, run in enumerate(["Random", "K-plus", "Ungrouped"]):
        runlog.save_metrics(rec.where(F.col("grouping") == run), path, run_id=i)
    back = spark.read.schema("dataset string, grouping string, model string, Accuracy double, `F1-score` double, run_id int").json(path)
    return back.groupBy("run_id", "grouping", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Accuracy").alias("accuracy"), F.sum("F1-score").alias("f1"))


@query("s8_summary_json")
def s8_summary_json(spark, sf):
    """The nested summary, read back cell by cell."""
    nested = R.summary_json(perf_report(spark, sf), PERFORMANCE_KEYS)
    per_metric = nested.select("metric", F.explode(F.from_json("json", "map<string,map<string,double>>")).alias("grouping", "cells"))
    return per_metric.select("metric", "grouping", F.explode("cells").alias("dataset", "value"))


@query("s9_overlay_long")
def s9_overlay_long(spark, sf):
    return R.overlay_long(bc_precision(spark, sf))


@query("v7_run_summary")
def v7_run_summary(spark, sf):
    return V.run_summary(run_records(spark, sf), ["dataset", "model", "grouping"], ["Accuracy", "F1-score"])


@query("v8_recall")
def v8_recall(spark, sf):
    return R.with_recall(run_records(spark, sf)).select("file_name", "Recall")


# ---------------------------------------------------------------- F9/F10, J6/J7 population kernels
from equigroup.functions.hashing import hash_below  # noqa: E402
from equigroup.operators import kernels as K  # noqa: E402

ORD_POINT_FEATURES = ["o_totalprice", "c_acctbal"]


def ord_populations(spark, sf):
    d = prep.zscore(C.c_ord(spark, sf).select("o_orderkey", "c_mktsegment", *ORD_POINT_FEATURES),
                    ORD_POINT_FEATURES)
    return d, d.filter(F.col("c_mktsegment") != "BUILDING")


@query("f9_observation_bias")
def f9_observation_bias(spark, sf):
    emp, rem = ord_populations(spark, sf)
    return K.observation_bias(emp, rem, "o_orderkey", ORD_POINT_FEATURES)


@query("j6_kernel_density")
def j6_kernel_density(spark, sf):
    emp, _ = ord_populations(spark, sf)
    pts = K.sample_points(emp, "o_orderkey", ORD_POINT_FEATURES)
    return K.kernel_density_at(pts, emp, ORD_POINT_FEATURES)


def doc_populations(spark, sf):
    d = materialize(C.all_doc(spark, sf).select("doc_id", "lang", "n_chars"))
    return d, d.filter(F.col("lang") != "en")


@query("f10_structural_bias")
def f10_structural_bias(spark, sf):
    emp, rem = doc_populations(spark, sf)
    return K.structural_bias(emp, rem, "doc_id", "n_chars")


@query("j7_knn_join")
def j7_knn_join(spark, sf):
    emp, rem = doc_populations(spark, sf)
    both = (emp.select("doc_id", "n_chars").withColumn("origin", F.lit(0))
            .unionByName(rem.select("doc_id", "n_chars").withColumn("origin", F.lit(1))))
    both = both.withColumn("_k", F.concat(F.col("origin").cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    both = both.withColumn("_test", hash_below("_k", 0.3, 42))
    return K.knn_1d(both.filter(~F.col("_test")), both.filter(F.col("_test")), "_k", "n_chars", "origin")


POINT = ["e0", "e1", "e2"]


def emb_populations(spark, sf):
    """All vectors and those of a label other than 0, by their first three components."""
    d = materialize(read_table(spark, sf, "embeddings").select("vec_id", "label", *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(POINT)]))
    return d, d.filter(F.col("label") != 0)


@query("f10_structural_bias_features")
def f10_structural_bias_features(spark, sf):
    emp, rem = emb_populations(spark, sf)
    return K.structural_bias_on(emp, rem, "vec_id", POINT)


@query("j7_knn_features")
def j7_knn_features(spark, sf):
    train, test = K.two_populations(*emb_populations(spark, sf), "vec_id", POINT)
    return K.knn(train, test, "_k", POINT, "origin").select(
        *[F.col("q")[i].alias(c) for i, c in enumerate(POINT)], "rank", "neighbour", "distance", "neighbour_label")


@query("f11_fairness_record_full")
def f11_fairness_record_full(spark, sf):
    """The record with instance, observation and structural bias: predictions
    on labelled documents, densities of the orders, neighbours of all documents."""
    d, pts = _instance(spark, sf)
    orders, docs = ord_populations(spark, sf), doc_populations(spark, sf)
    return FA.full_record(d, "y_true", "y_pred", privileged(F.col("lang"), "en"), pts,
                          (*orders, "o_orderkey", ORD_POINT_FEATURES), (*docs, "doc_id", "n_chars"))


# ---------------------------------------------------------------- 2.9 models (rows-only checks)
from equigroup.operators import embed_fit, experiment, impute, shapley  # noqa: E402
from equigroup.operators import models as ML  # noqa: E402

DOC_X = ["n_chars", "toxic", "is_en"]


def doc_split(spark, sf):
    d = doc_features(spark, sf)
    d = d.withColumn("is_test", hash_below("doc_id", 0.2, 42))
    return d.filter(~F.col("is_test")), d.filter(F.col("is_test"))


def _fit_predict(spark, sf, model, params):
    train, test = doc_split(spark, sf)
    fitted = ML.fit(train, model, DOC_X, "y_true", params)
    return ML.predict(fitted, test, "y_true").select("doc_id", "y_true", "prediction", "p1")


@query("t1_logistic_regression", rounded=False)
def t1_logistic_regression(spark, sf):
    return _fit_predict(spark, sf, "LogisticRegression", {"C": 1.0})


@query("t2_random_forest", rounded=False)
def t2_random_forest(spark, sf):
    return _fit_predict(spark, sf, "RandomForest", {})


@query("t3_boosted_trees", rounded=False)
def t3_boosted_trees(spark, sf):
    return _fit_predict(spark, sf, "XGBoost", {})


def ord_encoded(spark, sf):
    return prep.encode_cohort(C.c_ord(spark, sf), ORD_SPEC)


ORD_X = ["o_totalprice", "c_acctbal", "n_regionkey", "o_orderpriority"]


@query("t3_boosted_trees_multiclass", rounded=False)
def t3_boosted_trees_multiclass(spark, sf):
    d = ord_encoded(spark, sf).withColumn("is_test", hash_below("o_orderkey", 0.2, 42))
    fitted = ML.fit(d.filter(~F.col("is_test")), "XGBoost", ORD_X, "o_orderstatus", {})
    return ML.predict(fitted, d.filter(F.col("is_test")), "o_orderstatus") \
        .select("o_orderkey", "o_orderstatus", "prediction", "p1")


@query("t4_mlp", rounded=False)
def t4_mlp(spark, sf):
    return _fit_predict(spark, sf, "MLP", {"hidden_layer_sizes": 16})


@query("t5_rff_svm", rounded=False)
def t5_rff_svm(spark, sf):
    return _fit_predict(spark, sf, "SVM", {"C": 1.0})


@query("t8_cv_tuning", rounded=False)
def t8_cv_tuning(spark, sf):
    train, _ = doc_split(spark, sf)
    folds = split.stratified_kfold(train, "y_true", "doc_id", 5)
    return ML.tune(folds, "LogisticRegression", DOC_X, "y_true", "fold", n_iter=30, parallelism=8)[2]


@query("t9_predict_proba", rounded=False)
def t9_predict_proba(spark, sf):
    return _fit_predict(spark, sf, "RandomForest", {})


@query("t10_experiment", rounded=False)
def t10_experiment(spark, sf):
    train, test = flow.prepare(C.c_na(spark, sf), ORD_SPEC)
    feats = [c for c in train.columns if c not in ("o_orderkey", "o_orderstatus")]
    return experiment.run_experiment(train, test, "o_orderkey", "LogisticRegression", feats, "o_orderstatus",
                                     sensitive=F.col("c_mktsegment_BUILDING") == 1.0)


@query("v6_repeated_kfold", rounded=False)
def v6_repeated_kfold(spark, sf):
    return experiment.repeated_kfold(doc_features(spark, sf), "doc_id", "LogisticRegression", DOC_X, "y_true", parallelism=8)


@query("e8_impute_classifier", rounded=False)
def e8_impute_classifier(spark, sf):
    d = C.c_na(spark, sf)
    return impute.impute_with_classifier(d, "c_mktsegment", ["o_totalprice", "n_regionkey"]) \
        .select("o_orderkey", "c_mktsegment", "imputed")


@query("e9_imputation_policy", rounded=False)
def e9_imputation_policy(spark, sf):
    d = C.c_na(spark, sf)
    return impute.imputation_policy(d, [], [("c_mktsegment", ["o_totalprice", "n_regionkey"])])


def emb_groups():
    return {g: [f"f{i}" for i in range(64) if W.emb_group_of(i) == g] for g in range(W.EMB_GROUPS)}


@query("b1_autoencoder_fit", rounded=False)
def b1_autoencoder_fit(spark, sf):
    return embed_fit.embed_feature_groups(C.c_emb(spark, sf), "vec_id", emb_groups())["decoder"]


@query("b2_dim_choice", rounded=False)
def b2_dim_choice(spark, sf):
    scaled, _ = embed_fit.scaled_features(C.c_emb(spark, sf), "vec_id", emb_groups())
    return spark.createDataFrame(embed_fit.choose_widths(scaled.persist(), "vec_id", emb_groups()), embed_fit.CHOICE)


def _lr_doc(spark, sf):
    train, test = doc_split(spark, sf)
    fitted = ML.fit(train, "LogisticRegression", DOC_X, "y_true", {"C": 1.0})
    return train, test, fitted


@query("a3_kmeans_background", rounded=False)
def a3_kmeans_background(spark, sf):
    train, _ = doc_split(spark, sf)
    centres = shapley.kmeans_background(train, DOC_X)
    return spark.createDataFrame([(i, f, float(c[j])) for i, c in enumerate(centres) for j, f in enumerate(DOC_X)],
                                 "centre int, feature string, value double")


def _shap(spark, sf):
    train, test, fitted = _lr_doc(spark, sf)
    bg = shapley.kmeans_background(train, DOC_X)
    return shapley.shapley_sampling(lambda df: ML.predict(fitted, df), test, "doc_id", DOC_X, bg)


@query("a2_shapley_sampling", rounded=False)
def a2_shapley_sampling(spark, sf):
    return _shap(spark, sf)


LINEAR_WEIGHTS = {"n_chars": 0.001, "toxic": -0.5, "is_en": 0.25}
LINEAR_BACKGROUND = [[1000.0, 0.0, 1.0], [2500.0, 1.0, 0.0], [400.0, 0.0, 0.0]]


@query("a2_shapley_linear")
def a2_shapley_linear(spark, sf):
    """Sampled Shapley values of a linear score: those have the closed form
    weight * (value - background mean), whatever the permutations."""
    score = " + ".join(f"{w!r}D * {f}" for f, w in LINEAR_WEIGHTS.items())
    return shapley.shapley_sampling(lambda df: df.withColumn("p1", F.expr(score)), doc_features(spark, sf), "doc_id",
                                    DOC_X, LINEAR_BACKGROUND)


@query("t10_grouped_experiment", rounded=False)
def t10_grouped_experiment(spark, sf):
    """Both flows over the documents, with attributions, the average distance of
    the protected feature's points, and the embedded model saved as one pipeline."""
    train, test = doc_split(spark, sf)
    own = {"sensitive": privileged(F.col("lang"), "en"), "protected": "is_en"}
    flows = {
        "ungrouped": lambda: experiment.run_experiment(train, test, "doc_id", "LogisticRegression", DOC_X, "y_true", mode="each_label", **own),
        "grouped": lambda: experiment.run_grouped_experiment(
            train, test, "doc_id", "LogisticRegression", {0: ["n_chars", "toxic"], 1: ["is_en"]}, "y_true",
            save_to=f"{checkpoint_dir(spark)}/grouped-{uuid.uuid4().hex}", **own)}
    with ThreadPoolExecutor(max_workers=2) as pool:  # the flows share nothing but their input
        plain, grouped = (f.result().withColumn("flow", F.lit(name)) for name, f in
                          [(name, pool.submit(run)) for name, run in flows.items()])
    return plain.unionByName(grouped)


#: Margins of three classes over the features and over latent columns of them.
MARGINS = {"n_chars": (0.001, -0.002, 0.0005), "toxic": (-0.5, 0.5, 0.25), "is_en": (0.25, 0.1, -1.0)}
LATENTS = {"group_0_dim0": ("0.001D * n_chars + toxic", 0, 0, (1.0, -2.0, 0.5)), "group_0_dim1": ("toxic - is_en", 0, 1, (-0.5, 0.5, 0.25)),
           "group_1": ("is_en", 1, 0, (0.25, 0.1, -1.0))}
LATENT_DECODER = [(0, 0, "n_chars", 1.0), (0, 1, "n_chars", 0.0), (0, 0, "toxic", 3.0), (0, 1, "toxic", -1.0), (1, 0, "is_en", 0.5)]


@query("a7_attribution_modes")
def a7_attribution_modes(spark, sf):
    """Raw and grouped, by class and aggregated: Shapley values of three linear
    margins at once, which have closed forms."""
    d = doc_features(spark, sf)
    inner = d.selectExpr("doc_id", *[f"{e} AS {name}" for name, (e, _, _, _) in LATENTS.items()])
    back = spark.createDataFrame(LINEAR_BACKGROUND, "n_chars double, toxic double, is_en double")
    inner_back = [list(r) for r in back.selectExpr(*[e for e, _, _, _ in LATENTS.values()]).collect()]
    decoder = spark.createDataFrame(LATENT_DECODER, "group_id int, dim int, feature string, w double")
    places = [(name, g, k) for name, (_, g, k, _) in LATENTS.items()]

    def margins(weights):
        sums = [" + ".join(f"{w[c]!r}D * {f}" for f, w in weights.items()) for c in range(3)]
        return lambda df: df.withColumn("scores", F.expr(f"array({', '.join(sums)})"))

    out = None
    for mode in ("each_label", "aggregated"):
        raw = shapley.attribute(margins(MARGINS), d, "doc_id", DOC_X, LINEAR_BACKGROUND, 3, mode)
        grouped = shapley.attribute(margins({n: w for n, (_, _, _, w) in LATENTS.items()}), inner, "doc_id", list(LATENTS), inner_back,
                                    3, mode, places, decoder)
        for kind, phi in (("raw", raw), ("grouped", grouped)):
            phi = phi.select(F.lit(f"{kind} {mode}").alias("mode"), "doc_id", "class", "feature", "phi")
            out = phi if out is None else out.unionByName(phi)
    return out


@query("a7_attribution_dispatch", rounded=False)
def a7_attribution_dispatch(spark, sf):
    phi = _shap(spark, sf).withColumn("class", F.lit(1))
    return A.range_stats(A.feature_ranges(phi, 5, 95, by=["class"]), by=["class"])


@query("p12_feature_presence")
def p12_feature_presence(spark, sf):
    """Groups of the embedding features (random grouping of the features that
    vary, P11) checked against the columns of the line-item cohort table."""
    feats = prep.non_constant_features(C.c_emb(spark, sf), C.EMB_FEATURES).select("feature")
    assign = G.random_grouping(feats, GROUPS_K)
    return prep.feature_presence(C.c_emb(spark, sf).drop("f63"), assign)


@query("g11_k_sweep_greedy", rounded=False)
def g11_k_sweep_greedy(spark, sf):
    """Greedy grouping at every k = 2..10 on one shared matrix (one Python
    task per k), each rated by mean diversity and minimum dispersion."""
    m = emb_matrix(spark, sf)
    assign = G.greedy_grouping(m, range(2, 11), feature_order=C.EMB_FEATURES).select("k", "group_id", "feature")
    return G.grouping_report(G.group_quality(assign, m, by=["k"]), by=["k"])


@query("g6_searched_grouping_report", rounded=False)
def g6_searched_grouping_report(spark, sf):
    """Grouping report for the bicriterion groups of the line-item matrix."""
    m = materialize(line_matrix(spark, sf))
    assign = G.bicriterion_grouping(m, [2], restarts=10).select("k", "group_id", "feature")
    return G.grouping_report(G.group_quality(assign, m, by=["k"]), m, normalize=True, by=["k"])


@query("j5_feature_pairs")
def j5_feature_pairs(spark, sf):
    """All unordered feature pairs of the line-item cohort (fi < fj) with the
    number of rows where both values and the target are set."""
    return info.conditional_mutual_information(C.c_line(spark, sf), C.LINE_FEATURES, C.LINE_TARGET) \
        .select("fi", "fj", "n")


@query("i3_dissimilarity_by_segment")
def i3_dissimilarity_by_segment(spark, sf):
    """One dissimilarity matrix per line status (two cohorts), one job."""
    feats = [f for f in C.LINE_FEATURES if f != "l_linestatus"]
    return info.dissimilarity(C.c_line(spark, sf), feats, C.LINE_TARGET, segment="l_linestatus")


@query("f11_fairness_by_segment")
def f11_fairness_by_segment(spark, sf):
    """Fairness record per document source (20 cohorts), one aggregate."""
    d = C.c_doc(spark, sf).select(
        "source", "lang", F.col("quality").alias("y_true"),
        F.when(F.col("n_chars") > 1500, F.lit(1)).otherwise(F.lit(0)).alias("y_pred"))
    return FA.fairness_record(d, "y_true", "y_pred", privileged(F.col("lang"), "en"), by=["source"])
