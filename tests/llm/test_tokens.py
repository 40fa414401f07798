import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex

from equigroup.llm import bpe, lengths, packing, tokens
from equigroup.llm.tokens import id_list, rank_encoding, safe_slices, tiktoken_pieces, tokenizers_pieces

from .helpers import AWKWARD, awkward, clashing, empty, rows

ALPHABET = (" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   　​ab'sStTrRe1२.,!-_éñ你😀́|<|endoftext|>")


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.TOKENIZER)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranks():
    return rank_encoding(read("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_pieces_equal_whole_texts(hf, ranks):
    rng = random.Random(1)
    a, b = tokenizers_pieces(read("byte_bpe_50k.json"), public_tokenizers.PATTERN), tiktoken_pieces(ranks)
    for _ in range(3000):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        assert id_list(a.ids(t)) == hf(t), repr(t)
        assert id_list(b.ids(t)) == ranks.encode_ordinary(t), repr(t)


def test_small_cache_changes_nothing(ranks):
    from equigroup.llm.tokens import PieceTokenizer, pack_ids
    p = PieceTokenizer(lambda t: pack_ids(ranks.encode_ordinary(t)), max_pieces=2)
    t = "one two three one two four five one"
    assert id_list(p.ids(t)) == ranks.encode_ordinary(t) and len(p.known) <= 2


def test_slices_cut_before_white_space():
    t = "ab cd\n\nef  gh" * 50
    parts = list(safe_slices(t, 7))
    assert "".join(parts) == t and len(parts) > 20
    assert all(not p[-1].isspace() and n[0].isspace() for p, n in zip(parts, parts[1:]))
    assert list(safe_slices("x" * 50, 7)) == ["x" * 50] and list(safe_slices("")) == [""]


def test_round_trip(spark, ranks):
    got = bpe.bpe_round_trip(clashing(awkward(spark))).collect()
    assert len(got) == len(AWKWARD)
    texts = sorted(t or "" for _, t, *_ in AWKWARD)
    assert sorted(r["decoded"].decode() for r in got) == texts
    for r in got:
        t = r["decoded"].decode()
        assert list(r["ids"]) == ranks.encode_ordinary(t) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode_ids(bpe.bpe_round_trip(awkward(spark)))
    assert sorted(r["decoded"].decode() for r in back.collect()) == texts
    assert bpe.bpe_round_trip(empty(spark)).count() == 0


def best_fit_bins(sizes, capacity):
    """Best-fit decreasing, one piece at a time."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(capacity - s)
    return len(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (1, 2, 7, 50, 64):
        for _ in range(60):
            sizes = [rng.randint(1, capacity) if rng.random() < 0.6 else max(1, capacity // 3) for _ in range(rng.randint(0, 80))]
            counts = {s: sizes.count(s) for s in set(sizes)}
            fill, used = {}, []
            for length, rank, each, first, offset in packing.plan(counts, capacity):
                nxt = [r for n, r, *_ in packing.plan(counts, capacity) if n == length and r > rank]
                for j in range((min(nxt) if nxt else counts[length]) - rank):
                    b, o = first + j // each, offset + j % each * length
                    used.append((b, o, length))
            for b, o, length in sorted(used):
                assert fill.get(b, 0) == o  # gapless
                fill[b] = o + length
            assert len(used) == len(sizes) and max(fill.values(), default=0) <= capacity
            assert len(fill) == best_fit_bins(sizes, capacity)


def test_plan_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_open_bins_find_the_tightest():
    rng = random.Random(3)
    tree, there = packing.OpenBins(37), set()
    for _ in range(500):
        r = rng.randint(0, 37)
        on = rng.random() < 0.4
        tree.put(r, on)
        (there.add if on else there.discard)(r)
        need = rng.randint(0, 37)
        assert tree.tightest(need) == min((x for x in there if x >= need), default=None)


def check_packing(got, want_ids, capacity=1024):
    """Every piece right, in place, and as few sequences as best fit needs."""
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert len(sequences) == best_fit_bins([r["length"] for r in got], capacity)
    for doc, ids in want_ids.items():
        copies = len([r for r in by_doc[doc] if r["piece"] == 0])
        packed = np.array(ids, "<u4").tobytes()
        for r in by_doc[doc]:
            assert r["ids_crc32"] == zlib.crc32(packed[4 * r["start"]:4 * (r["start"] + r["length"])])
            assert r["piece"] == 0 or r["length"] == capacity
        assert sum(r["length"] for r in by_doc[doc]) == copies * len(ids)


def test_packing(spark, hf):
    got = packing.best_fit_pack(clashing(awkward(spark)), keep_ids=True).collect()
    want = {}
    for i, t, *_ in AWKWARD:
        want[i] = hf(t or "") + [2]
    check_packing(got, want)
    assert sum(r["length"] for r in got) == sum(len(hf(t or "")) + 1 for _, t, *_ in AWKWARD)
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert packing.best_fit_pack(empty(spark)).count() == 0


def test_packing_query(spark, sf_small, hf):
    from equigroup.llm.queries import op2_best_fit_pack
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    check_packing(op2_best_fit_pack(spark, sf_small).collect(), {r["doc_id"]: hf(r["text"] or "") + [2] for r in docs})


def test_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    df = spark.range(200).selectExpr("id AS doc_id", "0 AS piece", "id % 7 + 1 AS length", "id AS extra")
    got = packing.pack(df, 16).collect()
    assert len(got) == 200 and {r["extra"] for r in got} == set(range(200))
    places = {(r["sequence_id"], r["offset"] + k) for r in got for k in range(r["length"])}
    assert len(places) == sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == best_fit_bins([r["length"] for r in got], 16)


def test_token_counts(spark):
    enc = rank_encoding(read("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = sorted(len(enc.encode_ordinary(t or "")) for _, t, *_ in AWKWARD)
    counts = lengths.token_counts(clashing(awkward(spark))).cache()
    got = {r["context_limit"]: r for r in counts.collect()}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        assert r["n_docs"] == n.count(limit) and r["docs_within"] == sum(x <= limit for x in n)
        assert r["tokens_within"] == sum(x for x in n if x <= limit) and r["docs_over"] == sum(x > limit for x in n)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n)
        assert r["dropped_tokens"] == sum(max(0, x - limit) for x in n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
        for q in filter(None, r["quantiles"].split(",")):
            assert n[max(1, -(-int(float(q) * 1000) * len(n) // 1000)) - 1] == limit
    assert sum(len([q for q in r["quantiles"].split(",") if q]) for r in got.values()) == len(lengths.QUANTILES)
    for limit in (0, 5, 1000, 10 ** 7):
        r = lengths.at_limit(counts, limit).first()
        assert tuple(r) == (sum(x <= limit for x in n), sum(x > limit for x in n), sum(min(x, limit) for x in n),
                            sum(max(0, x - limit) for x in n))
    assert rows(lengths.token_counts(empty(spark))) == []
    assert tuple(lengths.at_limit(lengths.token_counts(empty(spark)), 5).first()) == (0, 0, 0, 0)


def test_added_tokens_equal_the_plain_call(spark, tmp_path):
    """The registered query and the stage against the library as it comes."""
    import corpus_pipeline as cp
    from equigroup.llm.queries import op2_best_fit_pack
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.TOKENIZER)

    def plain(t):
        return tok.encode(t, add_special_tokens=False).ids
    mark = "<|endoftext|>"
    assert plain(f"hello {mark} world") == [31373, 220, 50256, 995]
    p = tokenizers_pieces(read("byte_bpe_50k.json"), public_tokenizers.PATTERN, added_tokens=True)
    rng = random.Random(4)
    parts = [mark, mark, mark[:-1], "<|", "|>", " ", "  ", "\n\n", "\x1c", "ab", " it's", "1", "é😀", "."]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert id_list(p.ids(t)) == plain(t), repr(t)
    texts = [f"one {mark} two", mark, mark * 700 + " end", "none", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: plain(t or "") + [2] for i, t in enumerate(texts)}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check_packing(op2_best_fit_pack(spark, str(tmp_path)).collect(), want)
    check_packing(cp.packing_stage(spark, docs, str(tmp_path)).collect(), want)


def test_long_white_space(ranks):
    p = tiktoken_pieces(ranks)
    for space in (" ", "\n", " \n", "\u3000"):
        for n in (99_999, 100_000, 100_001, 150_000):
            run = (space * n)[:n]
            for t in (run, "a" + run, run + "b c", f"x{run}'s y", f"a\x1c{run}b", f"a{run}\x1cb{run}", run + "\x1f"):
                assert id_list(p.ids(t)) == ranks.encode_ordinary(t), (space, n, t[:3], t[-3:])
    run = " " * 2_000_000
    for t in (run, "a" + run + "b", run + "\x1c" + run):
        assert ranks.decode(id_list(p.ids(t))) == t


def test_long_white_space_in_a_table(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs, keep_ids=False).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(("a" + " " * 2_000_000 + "b").encode()).hexdigest()
    assert sum(r["n_docs"] for r in lengths.token_counts(docs).collect()) == 2


def test_words_are_kept_without_their_punctuation():
    asked = []
    tok = tokens.PieceTokenizer(lambda piece: (asked.append(piece), piece.encode())[1])
    text = "eau eau, eau. (eau) eau! l'eau eau"
    assert tok.ids(text) == text.encode()
    assert asked.count(" eau") == 1 and not [p for p in asked if p in (" eau,", " eau.", " eau!")]


def test_pieces_end_where_matches_end():
    find = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(7)
    letters = list(" \n\t  '\u2019._-,!(0123\u00b2\u00b3\u00b9\u00bd\u2167\u2173\u4e00\u00aa\u00df\u00ba\u00c9\u00e9\u0301\u0308\u0558\u058b\u0663\u07c0ab\U00010107\u3240") + ["'s", "'ll", " a", "  ", "a\u00b23"]
    for _ in range(20_000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 9)))
        pieces = tokens._PIECE.findall(text)
        assert "".join(pieces) == text and [m for p in pieces for m in find(p)] == find(text)
