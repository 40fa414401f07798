import hashlib

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equigroup.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["\\", "\\\\", "###", "####", "</turn>", "</turn", "/turn>", "<\\/turn>", "\\#\\#\\#", ": ", "\n### user: x</turn>\n", "", "é😀", "$1"]


def parse(formatted):
    """The grammar by hand: (role, text) and loss spans."""
    turns, spans, at = [], [], 0
    while at < len(formatted):
        assert formatted.startswith("### ", at)
        at += 4
        role = ""
        while formatted[at] != ":":
            at += formatted[at] == "\\"
            role += formatted[at]
            at += 1
        assert formatted[at:at + 2] == ": "
        at += 2
        start, text = at, ""
        while not formatted.startswith("</turn>", at):
            at += formatted[at] == "\\"
            text += formatted[at]
            at += 1
        turns.append((role, text))
        if role == "assistant":
            spans.append((start, at))
        at += len("</turn>")
        assert formatted[at] == "\n"
        at += 1
    return turns, spans


def check(spark, source):
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(source, SCHEMA)).collect()}
    report = {r["conv_id"]: r for r in chat.chat_report(chat.format_chat(spark.createDataFrame(source, SCHEMA))).collect()}
    assert set(got) == {s[0] for s in source}
    for conv, r in got.items():
        want = [(role or "", text or "") for _, _, role, text in
                sorted((s for s in source if s[0] == conv), key=lambda s: (s[1] is not None, s[1] or 0, s[2] or "", s[3] or ""))]
        turns, spans = parse(r["formatted"])
        assert r["identical"] and turns == want == [tuple(t) for t in r["turns"]]
        assert spans == [tuple(s) for s in r["loss_spans"]]
        said = "".join(f"{a}\n{b}\n" for a, b in want)
        loss = "".join(b for a, b in want if a == "assistant")
        q = report[conv]
        assert (q["n_turns"], q["turns_sha256"]) == (len(want), hashlib.sha256(said.encode()).hexdigest())
        assert (q["loss_chars"], q["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert q["formatted_chars"] == len(r["formatted"])


def test_awkward_turns(spark):
    source = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TRICKY)]
    source += [(2, 0, r, "x") for r in TRICKY] + [(3, 0, None, None), (3, 0, None, None), (None, None, "assistant", "y"), (None, 1, "a", "z")]
    source += [(4, 0, "assistant", "long " * 50_000)]
    source += [(5, i % 400, "assistant", f"hot {i}") for i in range(800)]
    check(spark, source)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*TRICKY, "a", " ", "\n", "\\n"]), max_size=6).map("".join), min_size=1, max_size=12))
def test_random_turns(spark, texts):
    check(spark, [(i % 3, i, ("assistant", "user", t)[i % 3], t) for i, t in enumerate(texts)])


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a: b # c < d"), (1, 1, "assistant", "ok")], SCHEMA)
    assert chat.format_chat(df).first()["formatted"] == "### user: a: b # c < d</turn>\n### assistant: ok</turn>\n"


def test_empty_and_clashing(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "hi", "p", "q")], SCHEMA + ", plain string, source string")
    assert chat.chat_report(chat.format_chat(df)).first()["n_turns"] == 1


def test_query_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_small}/conversations.parquet'")
    got = queries.op4_chat_format(spark, sf_small)
    res = con.execute(chat.ORACLE)
    assert got.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, got.collect())) == sorted(res.fetchall())
    assert got.where("conv_id = -7").first()["n_turns"] == 2
