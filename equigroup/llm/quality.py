"""Text quality by naive Bayes support vectors.

Features are n-gram indicators over a text's words and over their shapes (runs
of lower case, upper case and digits collapsed; a word equal to the one before
it has a shape of its own), so that layout, shouting, symbols and stuttering
show in any language. Shapes are taken over the whole of a word, a long one as
several in a row, and a word of more than ``LONG_WORD`` characters (a text with
few or no blanks) adds all its pairs of neighbouring characters. Each indicator is scaled by its class log-count ratio,
and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent. A logistic curve over held-back margins makes it a score.

The fit takes at most ``fit_rows`` labelled rows (those whose ids hash lowest)
and at most ``max_features`` features (the most frequent), so the model is a
bounded object and may be broadcast. Scoring is one scan without a shuffle.

Defined cases: null text is empty; an empty text has no feature and gets the
score of the intercept; labels other than 0 and 1, null labels and null ids are
not learned from; of repeated labels of an id the least counts; with no labels,
or labels of one class only, every score is the class share (0.5 with none);
repeated rows score alike; extra columns are not read, or carried whole by
``keep_good``; an empty table gives an empty result.
"""

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equigroup.llm.common import col, id_text, materialize

FIT_ROWS, MAX_FEATURES, MIN_ROWS = 12_000, 30_000, 3
THRESHOLD = 0.7
#: Characters of one shape; longer ones go on in the next.
SHAPE_CHARS = 12
#: Words over this length also give character pairs; they are not kept by ``Shapes``.
LONG_WORD = 20

_RUNS = re.compile("a+|A+|0+")


def shape(word: str) -> str:
    """The whole ``word`` with runs of lower case, upper case and digits as one
    of a, A and 0; other characters stay."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(lambda m: m.group()[0], out)


class Shapes(dict):
    """word -> its shape in consecutive parts of ``SHAPE_CHARS``, worked out
    once for words that are not long; emptied when it gets large."""

    def __missing__(self, word: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        whole = shape(word)
        s = tuple(whole[i:i + SHAPE_CHARS] for i in range(0, len(whole), SHAPE_CHARS))
        if len(word) <= LONG_WORD:
            self[word] = s
        return s


def features(text: str, shapes: Shapes) -> set:
    """The n-gram indicators of a text: single words, one to three shapes in a
    row, and the character pairs of long words (each after a line feed, which
    no word holds). A word equal to the one before it has the shape '='."""
    words = text.split()
    out: set = set(words)
    parts = [shapes[w] for w in words]
    if len(out) < 0.8 * len(words):
        parts = parts[:1] + [("=",) if a == b else t for a, b, t in zip(words, words[1:], parts[1:])]
    s = list(chain.from_iterable(parts))
    for w in [w for w in out if len(w) > LONG_WORD]:
        out.update({"\n" + a + b for a, b in zip(w, w[1:])})
    out.update(zip(s), zip(s, s[1:]), zip(s, s[1:], s[2:]))
    return out


def _name(feature) -> str:
    """A feature as text: a word as it is, shapes each after a tab."""
    return feature if isinstance(feature, str) else "".join("\t" + s for s in feature)


def _key(name: str):
    return tuple(name[1:].split("\t")) if name.startswith("\t") else name


def log_count_ratio(with_1: np.ndarray, with_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """log of a feature's smoothed share of class 1 over that of class 0."""
    return np.log((with_1 + 1) / (n_1 + 2)) - np.log((with_0 + 1) / (n_0 + 2))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray,
                 epochs: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear model with hinge loss and L2
    penalty over indicators times ``scale``, each row normalised to length one
    (intercept input 1), by coordinate descent on the dual variables. ``y`` is
    +-1, ``cost`` bounds each row's dual variable."""
    w, b = np.zeros(len(scale)), 0.0
    norm = np.array([math.sqrt((scale[r] ** 2).sum()) or 1.0 for r in rows])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] / norm[i]
            q = float(x @ x) + 1.0
            grad = y[i] * (float(w[r] @ x) + b) - 1.0
            new = min(max(alpha[i] - grad / q, 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def logistic_fit(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin) by Newton steps on smoothed targets."""
    n1, n0 = t.sum(), len(t) - t.sum()
    goal = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones_like(m)], 1)
    v = np.array([1.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * v * np.array([1, 0]))
        v = v - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


def flat_model(n1: int, n0: int) -> dict:
    """The model of one class, or of no label: the class share as every score."""
    share = n1 / (n1 + n0) if n1 + n0 else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    return {"weights": {}, "intercept": 0.0, "slope": 0.0, "offset": math.log(share / (1 - share))}


def fit_model(vocab: list[str], with_1: np.ndarray, with_0: np.ndarray, rows: list[np.ndarray],
              labels: np.ndarray) -> dict:
    """The model of rows of feature numbers and their labels (0, 1), with the
    features' counts by class: for each feature its weight in a score and what
    it adds to the square of the row's length; intercept, slope and offset."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n1 or not n0 or not vocab:
        return flat_model(n1, n0)
    ratio = log_count_ratio(with_1, with_0, n1, n0)
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))  # both classes weigh the same

    def margins(w, b, part):
        return np.array([w[r] @ ratio[r] / (math.sqrt((ratio[r] ** 2).sum()) or 1.0) + b for r in part])

    fold = np.arange(len(rows)) % 5 == 0  # margins for the curve come from rows left out
    if len(set(y[fold])) == 2 and len(set(y[~fold])) == 2:
        w, b = dual_descent([r for r, f in zip(rows, fold) if not f], y[~fold], ratio, cost[~fold])
        m, t = margins(w, b, [r for r, f in zip(rows, fold) if f]), (y[fold] > 0).astype(float)
    else:
        w, b = dual_descent(rows, y, ratio, cost)
        m, t = margins(w, b, rows), (y > 0).astype(float)
    slope, offset = logistic_fit(m, t)
    return {"weights": {_key(f): (float(w[i] * ratio[i]), float(ratio[i] ** 2)) for i, f in enumerate(vocab)},
            "intercept": float(b), "slope": slope, "offset": offset}


def score_text(model: dict, text: str, shapes: Shapes) -> float:
    get, dot, square = model["weights"].get, 0.0, 0.0
    for hit in map(get, features(text, shapes)):
        if hit is not None:
            dot += hit[0]
            square += hit[1]
    m = dot / (math.sqrt(square) or 1.0) + model["intercept"]
    return 1 / (1 + math.exp(-min(max(model["slope"] * m + model["offset"], -30.0), 30.0)))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, features) of at most ``fit_rows`` rows that may be learned from."""
    known = (labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("y"))
             .where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))

    def extract(batches):
        shapes = Shapes()
        for batch in batches:
            f = [[_name(x) for x in features(t.as_py(), shapes)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(f, pa.list_(pa.string()))],
                                             ["doc_id", "y", "features"])

    texts = id_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # fit_rows rows at most
    return texts.mapInArrow(extract, "doc_id long, y int, features array<string>").dropDuplicates(["doc_id"])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS,
                max_features: int = MAX_FEATURES, min_rows: int = MIN_ROWS, id_col: str = "doc_id",
                text_col: str = "text") -> dict:
    """The model. Class counts of the features are taken by Spark; what comes
    to the driver is bounded: ``max_features`` counts and, for ``fit_rows``
    rows, the numbers of their features among those, as one Arrow table whose
    flat number array the rows are views of."""
    rows = materialize(training_rows(docs, labels, label_col, fit_rows, id_col, text_col))
    counts = (rows.select("y", F.explode("features").alias("feature")).groupBy("feature")
              .agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
              .orderBy(F.desc("n"), "feature").limit(max_features).collect())
    vocab = [r["feature"] for r in counts]
    with_1 = np.array([r["n1"] for r in counts], float)
    numbers = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(vocab)})

    def number(batches):
        get = numbers.value.get
        for batch in batches:
            n = [sorted(i for i in map(get, f.as_py()) if i is not None) for f in batch.column("features")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(n, pa.list_(pa.int32()))],
                                             ["doc_id", "y", "numbers"])

    fit = rows.mapInArrow(number, "doc_id long, y int, numbers array<int>").orderBy("doc_id").toArrow().combine_chunks()
    lists = fit["numbers"].combine_chunks() if fit.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit_model(vocab, with_1, np.array([r["n"] for r in counts], float) - with_1,
                     [flat[a:b] for a, b in zip(ends, ends[1:])], fit["y"].to_numpy().astype(np.int64))


def quality_score(model: dict, spark: SparkSession, text: Column) -> Column:
    """The score of a text column as a column; the model (at most
    ``max_features`` weights) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes, m = Shapes(), shared.value
        for part in parts:
            yield pd.Series([score_text(m, t, shapes) for t in part], dtype=float)

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on)."""
    src = id_text(docs, id_col, text_col)
    scored = src.select("doc_id", quality_score(model, docs.sparkSession, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score at least ``threshold``, with their columns as they were."""
    return docs.where(quality_score(model, docs.sparkSession, col(text_col)) >= threshold)
