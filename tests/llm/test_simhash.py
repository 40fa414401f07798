import random
import re

import numpy as np
import xxhash

from equigroup.llm import queries
from equigroup.llm import simhash as sh

from .helpers import AWKWARD, CLASHES, awkward, clashing, empty


def plain_fingerprint(text, words=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, bits=2):
    """id -> (fingerprint, smallest reachable id), by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    u = sorted(set(fps))
    a = np.array(u, np.uint64)
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(u)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= bits)[0]:
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    root = {f: find(i) for i, f in enumerate(u)}
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return [(i, format(f, "016x"), least.get(root[f])) for (i, _), f in zip(rows, fps)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_awkward_rows(spark):
    want = plain_groups([(r[0], r[1]) for r in AWKWARD])
    got = [tuple(r) for r in sh.near_groups(clashing(awkward(spark))).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sh.near_groups(empty(spark)).count() == 0 and sh.near_dedup(empty(spark)).count() == 0


def test_chunked_shingles(monkeypatch):
    t = " ".join(f"w{i % 37}" for i in range(500))
    monkeypatch.setattr(sh, "CHUNK", 7)
    assert sh.fingerprint(t) == plain_fingerprint(t)
    for t in ("", "one", "one two", "one two three", "A b\tC\nd \x1c e"):
        assert sh.fingerprint(t) == plain_fingerprint(t)


def linked(spark, fps, bits):
    """Components of signed fingerprints, through the operator and by all pairs."""
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {f: f for f in fps} | {r["node"]: r["root"] for r in sh.components(sh.links(df, bits)).collect()}
    a = np.array(fps, np.int64).view(np.uint64)
    seen, want = set(), {}
    for s in range(len(fps)):
        if s in seen:
            continue
        todo, comp = [s], []
        seen.add(s)
        while todo:
            i = todo.pop()
            comp.append(i)
            for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= bits)[0]:
                if int(j) not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        for i in comp:
            want[fps[i]] = min(fps[j] for j in comp)
    return got, want


def test_links_are_complete(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(30):  # loose pairs, chains and crowds, with bits in either half and the sign
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 40])):
            fps.add(f)
            g = f
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                g ^= 1 << b
            fps.add(g)
            f = rng.choice([f, g])
    fps |= {0, 1, 3, 1 << 63, (1 << 64) - 1}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    for bits in (1, 2):
        got, want = linked(spark, fps, bits)
        assert got == want


def test_long_chain(spark):
    fps, f = [], 0
    for i in range(64):
        fps.append(f - (1 << 64) if f >> 63 else f)
        f ^= 1 << i
    got, want = linked(spark, fps, 1)
    assert got == want and len(set(got.values())) == 1


def test_one_of_each_group_stays(spark):
    df = clashing(awkward(spark))
    got = sh.near_dedup(df).collect()
    assert list(got[0].asDict()) == df.columns and all(r[c] == f"own {c}" for r in got for c in CLASHES)
    want = {c for i, _, c in plain_groups([(r[0], r[1]) for r in AWKWARD]) if i is not None}
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in got) == 1


def test_query(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op10_simhash(spark, sf_small).collect())) == sorted(plain_groups(docs))


def test_rows_not_ids_stay(spark):
    """Ids that are shared or missing name no document."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (None, c), (None, c), (None, c), (None, a), (5, c.upper()), (None, "alone"), (None, "other")],
                               "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in sh.near_dedup(df).collect()), key=key)
    assert got == sorted([(1, a), (1, b), (5, c.upper()), (None, "alone"), (None, "other")], key=key)
    one = sh.near_dedup(spark.createDataFrame([(None, a)] * 4, "doc_id long, text string"))
    assert [tuple(r) for r in one.collect()] == [(None, a)]
