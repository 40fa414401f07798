import hashlib
import random
import re

from equigroup.llm import pii, queries

from .helpers import AWKWARD, CLASHES, awkward, clashing, empty

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(x - 9 if x > 9 else x for x in double)) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def check(df, texts):
    got = pii.pii_report(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(s[2] for s in want).encode()).hexdigest(), texts[r["doc_id"]]
        assert {s[2] for s in want} <= set(r["spans"].split(","))
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(s[3] == kind for s in want)
    return got


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hard_matches(spark):
    texts = ["a@b.c@d.e x@y.z_q@w.e a@b.c_x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112",
             "+1 (509) 555-6973 +44 20 7946 0958 ++12345678901 +1 +2", "😀a@b.co 😀+1 555 123 4567", None, "", "1" * 20_000 + " " + "a" * 100_000 + "@",
             "a@b.co " * 3000, "1.2.3.4" * 2000, "4242424242424242\n" * 500]
    check(frame(spark, texts), texts)


def test_random_texts(spark):
    rng = random.Random(4)
    parts = ["a", "@", ".", "b.c", "1", "25", "256", "-", " ", "+", "(", ")", "4111111111111111", "0", "\n", "_", "x@y.zz", "é", "1.1.1.1", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    check(frame(spark, texts), texts)


def test_added_kinds_and_context(spark):
    texts = ["pay to DE89370400440532013000 or GB82 WEST 1234 5698 7654 32 now", "DE88370400440532013000", "my ssn is 123-45-6789",
             "part 123-45-6789", 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"', "hash 9c8b45435718dcc700c184a7e303cdc64c6a8f7f",
             "ssn 000-45-6789"]
    got = [r["spans"] for r in sorted(check(frame(spark, texts), texts), key=lambda r: r["doc_id"])]
    assert got == ["iban:7:29,iban:33:60", "", "ssn:10:21", "", "secret:9:49", "", ""]


def test_redaction(spark):
    df = clashing(awkward(spark))
    got = pii.redact(df).collect()
    assert list(got[0].asDict()) == df.columns and len(got) == len(AWKWARD)
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
    by = {r["doc_id"]: r for r in got}
    assert by[10]["text"] == "mail me: <email> or call <phone>" and by[10]["n_chars"] == len(by[10]["text"])
    assert by[2]["text"] is None and by[8]["text"] == "word " * 30_000 and by[8]["n_chars"] == 150_000
    overlap = spark.createDataFrame([(1, "x +4222222222222 y", 0)], "doc_id long, text string, n_chars int")
    out = pii.redact(overlap).first()["text"]
    assert not re.search("[0-9]{5}", out) and out.startswith("x <") and out.endswith(" y")
    assert pii.redact(empty(spark)).count() == 0 and pii.pii_report(empty(spark)).count() == 0


def test_query(spark, sf_small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = queries.op9_pii(spark, sf_small)
    assert "Python" not in got._jdf.queryExecution().toString()
    check(spark.read.parquet(f"{sf_small}/documents.parquet"), texts)


def test_very_many_matches(spark):
    """100,000 addresses in one text, and spans that overlap or touch."""
    many = "".join(f"u{i}@host{i % 7}.example.org, " for i in range(100_000))
    mixed = "😀 call +1 509 555 6973 or mail a@b.co\n" * 5000 + "x" * 1000 + "4111111111111111"
    texts = [many, mixed]
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in check(df, texts)}
    assert got[0]["n_email"] == 100_000 and got[1]["n_phone"] == 5000 == got[1]["n_email"] and got[1]["n_card"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == "<email>, " * 100_000
    assert clean[1] == "😀 call <phone> or mail <email>\n" * 5000 + "x" * 1000 + "<card>"


def test_context_is_that_of_the_text(spark):
    """Context words 40 characters away count, farther ones don't, also across pieces and other matches."""
    rows, want = [], []
    for lead in (0, 200, 255, 256, 300):
        for gap in (1, 30, 36, 37, 38, 60):
            before = " " * lead + "ssn" + "." * gap
            rows.append(before + "123-45-6789")
            want.append("ssn" in before[-pii.NEAR:])
            after = " " * lead + "123-45-6789" + "." * gap + "ssn"
            rows.append(after)
            want.append("ssn" in after[lead + 11:lead + 11 + pii.NEAR])
    got = {r["doc_id"]: r["spans"] != "" for r in pii.pii_report(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want
