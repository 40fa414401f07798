"""Toxicity by character n-grams under naive Bayes log-count ratios.

A text's features are the indicators of its character n-grams (3 to 7
characters of the lower-cased text, within a word and its bordering blanks),
hashed into a fixed space of 2^20 slots. Each indicator is scaled by its slot's
log-count ratio between the classes, and a linear model with logistic loss and
an L2 penalty is fitted on the scaled indicators, both classes weighing the
same. All n-grams of the whole text
count, whatever their frequency and the text's length; features are not
normalised by length, so a few words tell in a long text as in a short one.

The fit takes at most ``fit_rows`` labelled rows (those whose ids hash lowest).
Their slots stay in Spark (``FIT_PARTS`` partitions, written out); every step of
the optimiser (L-BFGS) is one job that adds up the tasks' losses and gradients. The
driver and the tasks hold some arrays of 2^20 numbers, whatever the rows.
Scoring is one scan without a shuffle; the broadcast model has 4 MB.

Defined cases: null text is empty; an empty or blank text has no feature and
gets the score of the intercept; labels other than 0 and 1, null labels and null
ids are not learned from; of repeated labels of an id the least counts, of
several texts of an id the least in order; with no labels, or labels of one
class only, every score is the class share (0.5 with none); repeated rows score
alike; very long texts go through in slices of ``SLICE`` characters that lose no
n-gram; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import col, id_text, materialize

FIT_ROWS, FIT_PARTS, THRESHOLD = 12_000, 8, 0.7
SPACE_BITS, SIZES, SLICE = 20, (3, 4, 5, 6, 7), 1 << 18
#: An array of all slots travels in so many rows.
SLICES = 16
#: Prior weight of a slot's counts, shared between the classes by their size.
PRIOR = 20.0
PENALTY = 0.1

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def grams(text: str) -> Iterator[np.ndarray]:
    """Slots of the n-grams of ``text``, with repeats, slice by slice."""
    words = " ".join(text.lower().split())
    if not words:
        return
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    reach = max(SIZES) - 1
    for at in range(0, len(codes), SLICE):
        c = codes[at:at + SLICE + reach]
        u = (c.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        blank = c == 32
        h, whole = u, np.ones(len(c), bool)
        for size in range(2, max(SIZES) + 1):
            n = len(c) - size + 1
            if n <= 0:
                break
            h = h[:n] * _MIX[1] + u[size - 1:]
            if size > 2:  # no blank between the first and the last character
                whole = whole[:n] & ~blank[size - 2:size - 2 + n]
            if size in SIZES:
                first = min(n, SLICE)  # later ones belong to the next slice
                own = h[:first][whole[:first]]
                yield ((own ^ (own >> np.uint64(32))) * _MIX[2] >> np.uint64(64 - SPACE_BITS)).astype(np.int32)


class Slots:
    """The distinct slots of one text after the other, in linear time: a slot
    carries the number of the n-gram that claimed it last."""

    def __init__(self):
        self.claim, self.next = np.full(1 << SPACE_BITS, -1, np.int64), 0

    def of(self, text: str) -> np.ndarray:
        start, out = self.next, [np.empty(0, np.int32)]
        for h in grams(text):
            h = h[self.claim[h] < start]
            number = np.arange(self.next, self.next + len(h))
            self.claim[h] = number
            out.append(h[self.claim[h] == number])
            self.next += len(h)
        return np.concatenate(out)


def log_count_ratio(with_1: np.ndarray, with_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """log of a slot's share of class 1 over that of class 0. The prior is
    shared by class size, so a slot seen in neither has the ratio 0."""
    n = n_1 + n_0
    p1, p0 = PRIOR * n_1 / n, PRIOR * n_0 / n
    return np.log((with_1 + p1) / (n_1 + PRIOR * n_1 / n)) - np.log((with_0 + p0) / (n_0 + PRIOR * n_0 / n))


def minimise(value_and_gradient, x: np.ndarray, steps: int = 40, memory: int = 4, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with step halving; ends when a step gains less than ``tolerance`` of the value."""
    value, g = value_and_gradient(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(past, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        slope, rate = float(g @ q), 1.0
        if slope <= 0:
            break
        while True:
            there = x - rate * q
            new, g_new = value_and_gradient(there)
            if new <= value - 1e-4 * rate * slope or rate < 1e-4:
                break
            rate /= 2
        if new >= value:
            break
        s, y = there - x, g_new - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        gain, x, value, g = value - new, there, new, g_new
        if gain < tolerance * max(abs(value), 1e-9):
            break
    return x


@dataclass
class ToxicityModel:
    """Weight of each slot (model weight times ratio) and the intercept."""
    intercept: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << SPACE_BITS, np.float32))

    def score(self, slots: np.ndarray) -> float:
        z = self.intercept + float(self.weights[slots].sum(dtype=float))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, slots) of at most ``fit_rows`` labelled documents; slots as 32-bit integers in a binary."""
    known = (labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("y"))
             .where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))

    def extract(batches):
        slots = Slots()
        for batch in batches:
            found = [slots.of(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.binary())], ["y", "slots"])

    texts = (id_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # fit_rows rows at most
             .groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    return texts.repartition(FIT_PARTS).mapInArrow(extract, "y int, slots binary")


def _summed(rows: DataFrame, sums) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all partitions of the numbers and the arrays that ``sums``
    makes of one. The arrays are added up by slices on the executors, in the
    order of the partitions, so that the driver gets one of each."""
    def part(batches):
        few, arrays = sums(batches)
        width = len(arrays) * (1 << SPACE_BITS) // SLICES
        flat = np.concatenate(arrays).astype(np.float32)
        data = [np.array(few, float).tobytes(), *(flat[i:i + width].tobytes() for i in range(0, len(flat), width))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(data) - 1, dtype=np.int32)),
                                          pa.array([TaskContext.get().partitionId()] * len(data), pa.int32()),
                                          pa.array(data, pa.binary())], ["slice", "part", "data"])

    def add(table):
        table = table.sort_by("part")
        at = table["slice"][0].as_py()
        kind = np.float64 if at < 0 else np.float32
        total = sum(np.frombuffer(d.as_buffer(), kind).astype(float) for d in table["data"])
        return pa.table({"slice": pa.array([at], pa.int32()), "data": pa.array([total.astype(kind).tobytes()], pa.binary())})

    got = (rows.mapInArrow(part, "slice int, part int, data binary").groupBy("slice")
           .applyInArrow(add, "slice int, data binary").collect())  # SLICES + 1 rows
    got.sort(key=lambda r: r["slice"])
    if not got:  # no partition at all
        return np.empty(0), np.empty(0, np.float32)
    return np.frombuffer(got[0]["data"]), np.frombuffer(b"".join(r["data"] for r in got[1:]), np.float32)


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each slot the rows of class 1 and of class 0 that have it; the classes' sizes."""
    def sums(batches):
        n, counts = [0, 0], np.zeros((2, 1 << SPACE_BITS), np.float32)
        for batch in batches:
            for y, s in zip(batch.column("y").to_pylist(), batch.column("slots")):
                counts[y][np.frombuffer(s.as_buffer(), np.int32)] += 1
                n[y] += 1
        return n, list(counts)

    n, counts = _summed(rows, sums)
    if not len(n):
        n, counts = [0, 0], np.zeros(2 << SPACE_BITS, np.float32)
    return counts[1 << SPACE_BITS:], counts[:1 << SPACE_BITS], int(n[1]), int(n[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS,
                 penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    rows = materialize(training_rows(docs, labels, label_col, fit_rows, id_col, text_col))
    with_1, with_0, n1, n0 = class_counts(rows)
    if not n1 or not n0:
        share = min(max(n1 / (n1 + n0) if n1 + n0 else 0.5, 1e-6), 1 - 1e-6)
        return ToxicityModel(math.log(share / (1 - share)))
    ratio = log_count_ratio(with_1, with_0, n1, n0)
    spark = rows.sparkSession
    weigh = ((n1 + n0) / (2 * n0), (n1 + n0) / (2 * n1))  # by class

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient at the weights x (the intercept is the last)."""
        shared = spark.sparkContext.broadcast(((x[:-1] * ratio).astype(np.float32), float(x[-1])))

        def sums(batches):
            v, b = shared.value
            pull, total, offset = np.zeros(len(v)), 0.0, 0.0
            for batch in batches:
                for y, s in zip(batch.column("y").to_pylist(), batch.column("slots")):
                    slots = np.frombuffer(s.as_buffer(), np.int32)
                    z = b + float(v[slots].sum(dtype=float))
                    total += weigh[y] * np.logaddexp(0.0, -z if y else z)
                    error = weigh[y] * (1 / (1 + math.exp(-min(max(z, -30.0), 30.0))) - y)
                    pull[slots] += error
                    offset += error
            return [total, offset], [pull]

        (total, offset), pull = _summed(rows, sums)
        shared.destroy()
        g = np.append(penalty * x[:-1], offset)
        g[:-1] += ratio * pull
        return 0.5 * penalty * float(x[:-1] @ x[:-1]) + total, g

    x = minimise(loss, np.zeros(len(ratio) + 1))
    return ToxicityModel(float(x[-1]), (x[:-1] * ratio).astype(np.float32))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches):
        slots, m = Slots(), shared.value
        for batch in batches:
            found = [m.score(slots.of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = id_text(docs, id_col, text_col).mapInArrow(part, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
