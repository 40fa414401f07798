import random

from equigroup.operators import kernels as K
from equigroup.operators import neighbours as N


def brute(train, test, k):
    """The k nearest of each distinct whole test point, ties by key."""
    out = {}
    whole = [t for t in train if None not in t[1:4]]
    for q in {t[1:4] for t in test if None not in t[1:4]}:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, t[1:4])) ** 0.5, t[0], t[4]) for t in whole)
        out[q] = [(key, lab) for _, key, lab in near[:k]]
    return out


def rows(n, seed, where):
    rng = random.Random(seed)
    return [(f"{where}{i:05d}", *[float(v) for v in rng.choice([
        [rng.randrange(6) / 2 for _ in range(3)], [0.5, 0.5, 0.5], [rng.gauss(0, 1) for _ in range(3)], [rng.gauss(40, 0.01) for _ in range(3)]])],
        rng.randrange(2)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, a double, b double, c double, y int")


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(tuple(r["q"]), []).append((r["rank"], r["neighbour"], r["neighbour_label"]))
    return {q: [t[1:] for t in sorted(v)] for q, v in got.items()}


def test_equal_to_brute_force(spark, monkeypatch):
    """Ties, a hot point, far clusters; few pivots and small blocks so that cells are split."""
    train, test = rows(900, 1, "t"), rows(200, 2, "q")
    train[0], test[0] = ("t00000", None, 1.0, 1.0, 0), ("q00000", 1.0, None, 1.0, 0)
    want = brute(train, test, 5)
    monkeypatch.setattr(N, "BLOCK", 64)
    for pivots in (1, 40):
        got = found(N.knn(frame(spark, train), frame(spark, test), "k", ["a", "b", "c"], "y", pivots=pivots))
        assert got == want


def test_fewer_rows_than_k_and_none(spark):
    train, test = rows(3, 3, "t"), rows(4, 4, "q")
    assert found(N.knn(frame(spark, train), frame(spark, test), "k", ["a", "b", "c"], "y")) == brute(train, test, 5)
    assert found(N.knn(frame(spark, []), frame(spark, test), "k", ["a", "b", "c"], "y")) == {}
    assert found(N.knn(frame(spark, train), frame(spark, []), "k", ["a", "b", "c"], "y")) == {}


def test_second_round_reads_only_cells_in_reach(spark, monkeypatch):
    """Two far clusters: no query looks into a cell of the other one."""
    rng = random.Random(5)
    train = [(f"t{i:03d}", 100.0 * (i % 2) + rng.random(), rng.random(), rng.random(), 0) for i in range(200)]
    test = [(f"q{i:03d}", rng.random(), rng.random(), rng.random(), 0) for i in range(30)]
    seen, look = [], N._look

    def watch(points, queries, k, width):
        seen.append((queries.collect(), {r["cell"]: r["x"][0] for r in points.collect()}))
        return look(points, queries, k, width)
    monkeypatch.setattr(N, "_look", watch)
    N.knn(frame(spark, train), frame(spark, test), "k", ["a", "b", "c"], "y", pivots=20).collect()
    assert len(seen) == 2 and all(at[r["cell"]] < 50 for asked, at in seen for r in asked)
    assert len(seen[1][0]) < 30 * 19


def test_structural_bias_on_one_feature_is_the_same(spark):
    both = frame(spark, rows(300, 6, "p"))
    rem = both.where("b > 0")
    one = K.structural_bias(both, rem, "k", "a").first()[0]
    assert abs(K.structural_bias_on(both, rem, "k", ["a"]).first()[0] - one) < 1e-12
