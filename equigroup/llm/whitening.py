"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi.

The centred scatter matrix is factored by Cholesky with diagonal pivoting,
A = P L, and the columns of the triangular factor are rotated against each
other (one-sided Jacobi) until they are orthogonal. The squared norms of the
rotated columns are the eigenvalues of the scatter, the normalised columns its
eigenvectors; the scatter itself is never diagonalised, so small eigenvalues
keep their relative accuracy.

Components become integers, floor(scale * c) + shift, and everything up to the
factor is exact: sums, and products of values centred at the rounded mean, are
whole numbers added as doubles below 2^53 in a task and as decimals between
tasks; what the rounded mean leaves is taken off in whole numbers on the driver.
So the result does not depend on how rows are dealt, and a large common shift
costs no digits.

Four scans: sums, scatter, covariance of the whitened values (for
``identity_error``), output. A task returns d sums or d x d products, whatever
its rows; the driver holds d x d numbers, d being the vector length (a few
thousand at most). Nothing is collected by row, no row is shuffled.

Defined cases: rows with a null vector, null or non-finite components, or
components beyond 2^40 / scale take no part, nor do rows of another length than
the most frequent one (the longer of equally frequent ones) or of length 0;
rows without an id take part and keep a null id; repeated rows count each time;
components of eigenvalue 0 (beyond the rank of the scatter) have no whitened
value and are left out, so equal vectors or a single row give no row, nor does
an empty table; ``deviation`` is null where it leaves a long; extra columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import col

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows of one product; their centred squares must stay exact as doubles.
ROWS = 4_096


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows with a whole, finite vector; x as doubles."""
    v = col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) * scale < float(1 << 40), F.lit(False)))
    return (df.select(col(id_col).cast("long").alias("id"), v.alias("x"))
            .where(F.col("x").isNotNull() & (F.size("x") > 0)).where(fine))


def matrices(batches, d: int, scale: int, shift: int):
    """(ids, integer matrix) slices of the batches' rows; all rows have length d."""
    for batch in batches:
        lists = batch.column("x")
        flat = lists.values.slice(lists.offsets[0].as_py(), len(lists) * d) if len(lists) else None
        for at in range(0, len(lists), ROWS):
            n = min(ROWS, len(lists) - at)
            part = np.floor(scale * flat.slice(at * d, n * d).to_numpy().reshape(n, d))
            yield batch.column("id").slice(at, n), part.astype(np.int64) + shift


def _longs(name: str, values: np.ndarray) -> pa.RecordBatch:
    """One row a number: its place and its value."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", name])


def fit_length(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent vector length, the longer of equals, and its number of rows."""
    top = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (top["d"], top["n"]) if top else (0, 0)


def exact_sums(vectors: DataFrame, d: int, scale: int, shift: int) -> list[int]:
    def part(batches):
        total = np.zeros(d, np.int64)
        for _, x in matrices(batches, d, scale, shift):
            total += x.sum(axis=0)
        yield _longs("value", total)

    rows = vectors.mapInArrow(part, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [0] * d
    for r in rows.collect():  # d rows
        out[r["place"]] = int(r["value"])
    return out


def exact_scatter(vectors: DataFrame, d: int, n: int, sums: list[int], scale: int, shift: int) -> list[list[int]]:
    """n^2 times the covariance as whole numbers: products of x minus the
    rounded mean, less what the rounding left."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(centre, np.int64)

    def part(batches):
        big = 0
        total = np.zeros((d, d))  # exact while below 2^53
        for _, x in matrices(batches, d, scale, shift):
            t = x - middle
            top = int(np.abs(t).max(initial=0)) ** 2 * len(t)
            if top < 2 ** 53:
                t = t.astype(float)
                p = t.T @ t
                if np.abs(total).max() + top >= 2 ** 53:
                    yield from spill(total)
                    total = np.zeros((d, d))
                total += p
            else:  # very large components: by halves of 20 bits, a quarter of the rows at a time
                high, low = t >> 20, t & 0xFFFFF
                for at in range(0, len(t), ROWS // 4):
                    h, m = (z[at:at + ROWS // 4].astype(float) for z in (high, low))
                    cross = (h.T @ m).astype(np.int64).astype(object)
                    big = big + ((h.T @ h).astype(np.int64).astype(object) * 2 ** 40 + (cross + cross.T) * 2 ** 20
                                 + (m.T @ m).astype(np.int64))
        yield from spill(total)
        if not isinstance(big, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array([str(v) for v in big.ravel()])], ["place", "value"])

    def spill(total):
        batch = _longs("value", total.astype(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("value").cast(pa.string())], ["place", "value"])

    rows = (vectors.mapInArrow(part, "place long, value string").groupBy("place")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
    left = [s - n * c for s, c in zip(sums, centre)]
    out = [[0] * d for _ in range(d)]
    for r in rows.collect():  # d x d rows
        i, j = divmod(r["place"], d)
        out[i][j] = n * int(r["value"]) - left[i] * left[j]
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A with A A' = v: rows in v's order, columns by falling pivot, as many as
    v has rank: what is left of a diagonal entry counts as 0 where it is within
    rounding (8 d x 2^-52) of nothing."""
    d = len(v)
    rest, a = v.copy(), np.zeros((d, d))
    order = np.arange(d)
    least = 8 * d * 2.0 ** -52 * np.diag(v)
    for k in range(d):
        left = rest[order[k:], order[k:]]
        p = k + int(np.argmax(np.where(left > least[order[k:]], left, 0.0)))
        order[[k, p]] = order[[p, k]]
        i, tail = order[k], order[k + 1:]
        if rest[i, i] <= least[i]:
            return a[:, :k]
        a[i, k] = math.sqrt(rest[i, i])
        a[tail, k] = rest[tail, i] / a[i, k]
        rest[np.ix_(tail, tail)] -= np.outer(a[tail, k], a[tail, k])
    return a


def jacobi_columns(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a a', falling, and its unit eigenvectors as columns: pairs
    of columns are rotated until all are orthogonal to rounding. The pairs of a
    round share no column (a round-robin), so a round is rotated at once."""
    a = a.copy()
    r = a.shape[1]
    seats = list(range(r + r % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[:half - 1:-1]) if max(p, q) < r]
            p, q = (np.array(s) for s in zip(*pairs)) if pairs else (np.empty(0, int), np.empty(0, int))
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > 2.0 ** -52
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            seats[1:] = [seats[-1], *seats[1:-1]]
        if worst <= 2.0 ** -51 * math.sqrt(max(r, 1)):
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


@dataclass
class Whitening:
    """A fitted transform: the length ``d`` and number ``n`` of the fit rows,
    their exact sums, the components (columns) with their eigenvalues and their
    share of the variance."""
    d: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scale: int = SCALE
    shift: int = SHIFT

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the rounded mean, and n times what x less the true mean has less."""
        centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return x - np.array(centre, np.int64), np.array([s - self.n * c for s, c in zip(self.sums, centre)], np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of an integer matrix."""
        t, left = self.centred(x)
        return (t - left / self.n) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list:
        """The exact sum over the columns of (n x - S)^2, None where it leaves a
        long: a sum modulo 2^64 is exact for those that stay, and only sums near
        the limit need whole numbers of any size to tell."""
        t, left = self.centred(x)
        about = ((t - left / self.n) ** 2).sum(axis=1) * float(self.n) ** 2 / 2 ** 63
        w = t.astype(np.uint64) * np.uint64(self.n) - left.astype(np.uint64)
        out = (w * w).sum(axis=1).tolist()
        for i in np.flatnonzero(about > 0.99).tolist():
            exact = sum((v * self.n - u) ** 2 for v, u in zip(t[i].tolist(), left.tolist())) if about[i] < 1.01 else 2 ** 63
            out[i] = exact if exact < 2 ** 63 else None
        return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The transform of ``usable_vectors`` rows, at most ``components`` wide."""
    d, n = fit_length(vectors)
    if not n:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), scale, shift)
    same = vectors.where(F.size("x") == d)
    sums = exact_sums(same, d, scale, shift)
    whole = exact_scatter(same, d, n, sums, scale, shift)
    v = np.array([[value / (n * n) for value in row] for row in whole])
    values, vectors_ = jacobi_columns(pivoted_cholesky(v))
    trace = sum(whole[i][i] for i in range(d)) / (n * n)
    values, vectors_ = values[:components], vectors_[:, :components]
    return Whitening(d, n, sums, vectors_, values, values / trace if trace else values, scale, shift)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the
    identity, over all fit rows. Whitened values are centred (their mean is 0 up
    to rounding, and that is taken off too)."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def part(batches):
        m = shared.value
        total, square = np.zeros(k), np.zeros((k, k))
        for _, x in matrices(batches, m.d, m.scale, m.shift):
            w = m.project(x)
            total += w.sum(axis=0)
            square += w.T @ w
        yield _longs("value", np.concatenate([total, square.ravel()]))

    rows = (vectors.where(F.size("x") == model.d).mapInArrow(part, "place long, value double")
            .groupBy("place").agg(F.sum("value").alias("value")).collect())  # k + k x k rows
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r["place"]] = r["value"]
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error, one row for each vector that takes part and component."""
    vectors = usable_vectors(df, id_col, vector_col, scale)
    model = fit_whitening(vectors, components, scale, shift)
    error = identity_error(vectors, model)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def part(batches):
        m = shared.value
        for ids, x in matrices(batches, m.d, m.scale, m.shift):
            w = m.project(x)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(m.deviation(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                ["id", "deviation", "w"])

    out = vectors.where(F.size("x") == model.d).mapInArrow(part, "id long, deviation long, w array<double>")
    share = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return (out.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"),
                    F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
