"""Counting the value cells of all feature pairs without a row per pair.

A row arrives once, as the array of its p value symbols. A task codes each
column by a dictionary that it grows as values come, and counts a pair's (x, y,
z) cells of a whole Arrow batch at once: by one count array where the codes'
product is small, else by sorting packed codes. Counts of the batches are merged
and leave the task as one row a distinct cell, at its end or when ``CELLS``
cells have gathered; dictionaries start anew when one reaches ``VALUES``. So
memory is bounded by those two numbers and a batch, and what is shuffled is the
distinct cells of a task, not rows times pairs. Near-unique columns have nearly
as many cells as rows for each of their pairs, and that much has to leave the
task; bin such columns first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Distinct cells a task holds, values of one dictionary, and codes counted in one array.
CELLS, VALUES, DENSE = 1_000_000, 1 << 20, 1 << 16


class Codes:
    """Codes 0, 1, ... of 64-bit values in the order they are first seen."""

    def __init__(self):
        self.sorted, self.code = np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.sorted)

    def of(self, values: np.ndarray) -> np.ndarray:
        seen, where = np.unique(values, return_inverse=True)
        at = np.searchsorted(self.sorted, seen)
        old = at < len(self.sorted)
        old[old] = self.sorted[at[old]] == seen[old]
        code = np.empty(len(seen), np.int64)
        code[old] = self.code[at[old]]
        code[~old] = len(self) + np.arange((~old).sum())
        if not old.all():
            every = np.concatenate([self.sorted, seen[~old]])
            order = np.argsort(every)
            self.sorted, self.code = every[order], np.concatenate([self.code, code[~old]])[order]
        return code[where]

    def values(self) -> np.ndarray:
        """The value of each code."""
        out = np.empty(len(self), np.int64)
        out[self.code] = self.sorted
        return out


def _count(x: np.ndarray, y: np.ndarray, z: np.ndarray, sizes: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (x, y, z) codes, packed by 21 bits each, and their counts."""
    if sizes[0] * sizes[1] * sizes[2] <= DENSE:
        n = np.bincount((x * sizes[1] + y) * sizes[2] + z)
        at = np.flatnonzero(n)
        rest, c = np.divmod(at, sizes[2])
        a, b = np.divmod(rest, sizes[1])
        return (a << 42) | (b << 21) | c, n[at]
    return np.unique((x << 42) | (y << 21) | z, return_counts=True)


class CellCounter:
    """Cells of the pairs (a, b), and of the single columns (b = -1, y and z 0),
    of rows given as symbol matrices. A row counts for a pair where x, y and z
    are there, for a column where x is. ``z`` holds the codes of (segment,
    target), ``segment`` those of the segment alone."""

    def __init__(self, p: int, pairs: list[tuple[int, int]]):
        self.jobs = [*pairs, *((j, -1) for j in range(p))]
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.codes = [Codes() for _ in range(self.p)]
        self.parts: dict[tuple[int, int], list] = {}
        self.held = 0

    def add(self, v: np.ndarray, there: np.ndarray, z: np.ndarray, z_there: np.ndarray, n_z: int, segment: np.ndarray, n_s: int):
        """Count a batch; yields what has to leave on the way."""
        if any(len(c) + len(v) > VALUES for c in self.codes):
            yield from self.emit()
        coded = np.zeros(v.shape, np.int64)
        for j in range(self.p):
            coded[there[:, j], j] = self.codes[j].of(v[there[:, j], j])
        coded = np.asfortranarray(coded)
        full, nothing = there.all(axis=0), np.zeros(len(v), np.int64)
        every_z = z_there.all()
        for a, b in self.jobs:
            whole = full[a] and (b < 0 or full[b] and every_z)
            x, y, c = coded[:, a], (coded[:, b] if b >= 0 else nothing), (z if b >= 0 else segment)
            if not whole:
                keep = there[:, a] & there[:, b] & z_there if b >= 0 else there[:, a]
                x, y, c = x[keep], y[keep], c[keep]
            sizes = (len(self.codes[a]), len(self.codes[b]), n_z) if b >= 0 else (len(self.codes[a]), 1, n_s)
            if len(x):
                key, n = _count(x, y, c, sizes)
                self.parts.setdefault((a, b), []).append((key, n))
                self.held += len(key)
            if self.held > CELLS:
                self.merge()
                if self.held > CELLS // 2:
                    yield from self.emit(keep_codes=True)

    def merge(self) -> None:
        self.held = 0
        for job, parts in self.parts.items():
            if len(parts) > 1:
                key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                self.parts[job] = [(key, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]
            self.held += len(self.parts[job][0][0])

    def emit(self, keep_codes: bool = False):
        """(a, b, x values, y values, z or segment codes, counts) of each job held."""
        self.merge()
        values = [c.values() for c in self.codes]
        for (a, b), [(key, n)] in self.parts.items():
            y = values[b][key >> 21 & 0x1FFFFF] if b >= 0 else np.zeros(len(key), np.int64)
            yield a, b, values[a][key >> 42], y, key & 0x1FFFFF, n
        if keep_codes:
            self.parts, self.held = {}, 0
        else:
            self.clear()


def count_cells(batches, p: int, pairs: list[tuple[int, int]], segment_type: pa.DataType):
    """Record batches (s, a, b, x, y, z, n) of the cells of a partition's rows
    (s, _v, _z): segment, array of p symbols, target symbol."""
    counter = CellCounter(p, pairs)
    targets: dict[tuple, int] = {}  # (segment, z) -> code
    segments: dict = {}

    def rows(groups):
        out = list(groups)
        if not out:
            return
        of_z = np.array([(segments[s], z or 0) for s, z in targets], np.int64).reshape(-1, 2)
        size = [len(g[2]) for g in out]
        single = np.repeat([g[1] < 0 for g in out], size)
        code = np.concatenate([g[4] for g in out])
        pair = of_z[np.where(single, 0, code)] if len(of_z) else np.zeros((len(code), 2), np.int64)
        s_names = pa.array(list(segments), segment_type).take(pa.array(np.where(single, code, pair[:, 0])))
        z_names = np.where(single, 0, pair[:, 1])
        yield pa.RecordBatch.from_arrays(
            [s_names, pa.array(np.repeat([g[0] for g in out], size).astype(np.int32)),
             pa.array(np.repeat([g[1] for g in out], size).astype(np.int32)), pa.array(np.concatenate([g[2] for g in out])),
             pa.array(np.concatenate([g[3] for g in out])), pa.array(z_names), pa.array(np.concatenate([g[5] for g in out]))],
            ["s", "a", "b", "x", "y", "z", "n"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lists = batch.column("_v")
        flat = lists.values.slice(lists.offsets[0].as_py(), n * p)
        v = flat.fill_null(0).to_numpy().reshape(n, p)
        there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(n, p)
        s = [segments.setdefault(x, len(segments)) for x in batch.column("s").to_pylist()]
        names = list(segments)
        z = [targets.setdefault((names[i], x), len(targets)) for i, x in zip(s, batch.column("_z").to_pylist())]
        z_there = batch.column("_z").is_valid().to_numpy(zero_copy_only=False)
        yield from rows(counter.add(v, there, np.array(z, np.int64), z_there, len(targets), np.array(s, np.int64), len(segments)))
        if len(targets) > VALUES // 2 or len(segments) > VALUES // 2:
            yield from rows(counter.emit())
            targets.clear()
            segments.clear()
    yield from rows(counter.emit())
