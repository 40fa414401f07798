"""Fixed values that must equal the reference's for right results.

FIXED VALUES — names, orders and constants used by the run-report parser,
the report layout, the encoders and the estimators. Stated as text, in the
reference's natural order.
"""

# FIXED VALUES: dataset token (lower case) -> canonical dataset name
DATASETS = {
    "diabetes": "Diabetes",
    "heart_disease": "Heart Disease",
    "breast_cancer": "Breast Cancer",
    "obesity": "Obesity",
}

# FIXED VALUES: model token (lower case) -> canonical model name (metric reports)
MODELS = {
    "xgboost": "XGBoost",
    "randomforest": "RandomForest",
    "mlp": "MLP",
    "logisticregression": "LogisticRegression",
    "svm": "SVM",
}

# FIXED VALUES: grouping token (lower case) -> canonical grouping name
GROUPINGS = {
    "bicriterion": "Bicriterion",
    "kplus": "K-plus",
    "random": "Random",
    "group_dissimilar": "Greedy",
    "benchmark": "Benchmark",
    "ungrouped": "Ungrouped",
}

# FIXED VALUES: report display orders
ORDERED_DATASETS = ["Breast Cancer", "Heart Disease", "Lung Cancer", "Obesity", "Diabetes"]
ORDERED_GROUPINGS = ["Benchmark", "Ungrouped", "Random", "Greedy", "K-plus", "Bicriterion"]

# FIXED VALUES: model token -> long model name used by the single-dataset comparison
BENCH_MODELS = {
    "xgboost": "Xgboost Classification",
    "randomforest": "Random Forest Classification",
    "mlp": "Neural Network Classification",
    "logisticregression": "Logistic Regression",
    "svm": "Support Vector Classification",
}
# FIXED VALUES: single-dataset comparison orders
BENCH_MODEL_ORDER = ["Xgboost Classification", "Support Vector Classification",
                     "Random Forest Classification", "Neural Network Classification",
                     "Logistic Regression"]
BENCH_GROUPING_ORDER = ["Ungrouped", "Random", "Greedy", "K-plus", "Bicriterion", "Benchmark"]

# FIXED VALUES: published external benchmark accuracy in percent (model, min, mean, max)
BENCHMARK_ACCURACY = [
    ("Xgboost Classification", 93.673, 97.002, 99.468),
    ("Support Vector Classification", 90.814, 94.768, 98.162),
    ("Random Forest Classification", 95.102, 97.94, 100.0),
    ("Neural Network Classification", 86.51, 91.635, 95.973),
    ("Logistic Regression", 91.555, 95.503, 98.576),
]

# FIXED VALUES: metric keys in run files
PERFORMANCE_KEYS = ["Accuracy", "F1-score", "Precision", "Recall"]
FAIRNESS_KEYS = [
    "Disparate Impact",
    "Equal Opportunity",
    "Equalized Odds",
    "Predictive Parity",
    "N-Sigma (ErrorRate)",
    "Average distance from origin",
]

# FIXED VALUES: estimator constants
RATE_EPS = 1e-6          # added to every fairness-rate denominator
DISSIM_EPS = 1e-9        # added to H(X) + H(Y) in the dissimilarity
PERF_USABLE_EPS = 0.0    # performance report drops exact zeros only
FAIR_USABLE_EPS = 1e-8   # fairness report also drops |v| < 1e-8
INSTANCE_ALPHA = 0.05    # instance-bias deviation threshold
KDE_BANDWIDTH = 0.5      # observation-bias Gaussian kernel bandwidth
KDE_SAMPLE_POINTS = 300  # observation-bias sample size (with replacement)
KNN_NEIGHBOURS = 5       # structural-bias neighbours
KNN_TEST_FRACTION = 0.3  # structural-bias hold-out
BICRITERION_WEIGHTS = [0.0001, 0.001, 0.01, 0.1, 0.5, 0.99]

# FIXED VALUES: hyper-parameter search spaces per model (prior, low, high) or
# ("categorical", [choices]); sizes, depth and rates as in the reference.
SEARCH_SPACES = {
    "LogisticRegression": {"C": ("log-uniform", 1e-2, 1e2)},
    "SVM": {"C": ("log-uniform", 1e-2, 1e2), "gamma": ("log-uniform", 1e-3, 1.0)},
    "MLP": {"hidden_layer_sizes": ("categorical", [50, 100, 200]),
            "alpha": ("log-uniform", 1e-4, 1e-1),
            "learning_rate_init": ("log-uniform", 1e-3, 3e-1)},
    "RandomForest": {"n_estimators": ("integer", 50, 500), "max_depth": ("integer", 3, 15),
                     "max_features": ("categorical", ["sqrt", "log2", None])},
    "XGBoost": {"n_estimators": ("integer", 50, 500), "max_depth": ("integer", 3, 15),
                "learning_rate": ("log-uniform", 1e-3, 3e-1), "subsample": ("uniform", 0.6, 1.0),
                "colsample_bytree": ("uniform", 0.6, 1.0)},
}
# FIXED VALUES: default model settings
MODEL_DEFAULTS = {"LogisticRegression": {"C": 1.0}, "SVM": {"C": 1.0, "gamma": "scale"},
                  "MLP": {"hidden_layer_sizes": 100}, "RandomForest": {"n_estimators": 100},
                  "XGBoost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3}}
