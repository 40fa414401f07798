r"""Chat formatting with a grammar round trip, DataFrame functions only.

Grammar of the formatted text::

    conversation := turn*
    turn         := "### " role ": " text "</turn>" "\n"

``</turn>`` and ``###`` are the control strings; a backslash takes the next
character as it is. Every turn is rendered plainly first and parsed again. Where
the parser doesn't give back the source turn, its content conflicts and is
escaped: backslashes are doubled, every ``#`` and the inside of ``</turn>`` get
one, so that control strings no longer occur as such. The whole text is parsed once more and
compared; if it still differed, all its turns would be escaped.

Defined cases: null texts and roles are empty; turns go by number, equal
numbers by role and text, a null number first; repeated rows are turns of their
own; a null conversation id is a conversation like any other; extra columns are
not read; an empty table gives an empty result. A conversation's turns meet in
one row, since that row is its formatted text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import col

OPEN, CLOSE, LOSS_ROLE = "###", "</turn>", "assistant"

_TURN = "struct<role:string,text:string>"
# raw SQL strings: r'\' can't end in a backslash, hence chr(92)
_ESC = fr"replace(replace(replace({{}}, chr(92), concat(chr(92), chr(92))), '{CLOSE}', r'<\/turn>'), '#', r'\#')"
_UNESC = r"regexp_replace({}, r'(?s)\\(.?)', '$1')"


def _render(role: str, text: str) -> str:
    return f"concat('{OPEN} ', {role}, ': ', {text}, '{CLOSE}', chr(10))"


def _escaped(role: str, text: str) -> str:
    return _render(f"replace({_ESC.format(role)}, ':', r'\\:')", _ESC.format(text))


def _parse(formatted: str) -> str:
    """SQL: the turns of a formatted text. What the grammar doesn't allow
    becomes a turn of nulls, so that it equals no source."""
    role = r"regexp_extract(b, r'(?s)^ ((?:[^:\\]|\\.)*+): ', 1)"
    turn = (f"CASE WHEN size(split(p, '{OPEN}')) = 2 THEN element_at(transform(array(split(p, '{OPEN}')[1]), b -> "
            f"named_struct('role', {_UNESC.format(role)}, 'text', {_UNESC.format(f'substring(b, length({role}) + 4)')})), 1) "
            f"ELSE CAST(named_struct('role', NULL, 'text', NULL) AS {_TURN}) END")
    return (f"transform(filter(split({formatted}, '{CLOSE}', -1), (p, i) -> i < size(split({formatted}, '{CLOSE}', -1)) - 1), "
            f"p -> {turn})")


def format_chat(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points of
    ``formatted`` that hold assistant content, ends exclusive), turns (role and
    text as parsed back from ``formatted``) and identical (whether those are
    the source's)."""
    rows = conversations.select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = rows.withColumn("plain", F.expr(_render("role", "text"))).withColumn("back", F.expr(_parse("plain")))
    chosen = plain.select("conv_id", "turn", "role", "text", F.expr(
        f"CASE WHEN size(back) = 1 AND back[0].role <=> role AND back[0].text <=> text THEN plain "
        f"ELSE {_escaped('role', 'text')} END").alias("out"))
    grouped = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "out"))).alias("source"))
    said = grouped.select("conv_id", F.expr("transform(source, s -> named_struct('role', s.role, 'text', s.text))").alias("source"),
                          F.expr("array_join(transform(source, s -> s.out), '')").alias("mixed"))
    read = said.withColumn("parsed", F.expr(_parse("mixed"))).withColumn("same", F.expr("parsed = source"))
    final = read.select("conv_id", "source", F.expr(
        "CASE WHEN same THEN mixed ELSE array_join(transform(source, s -> "
        f"{_escaped('s.role', 's.text')}), '') END").alias("formatted"))
    back = final.withColumn("turns", F.expr(_parse("formatted")))
    pieces = f"slice(split(formatted, '{CLOSE}', -1), 1, size(split(formatted, '{CLOSE}', -1)) - 1)"
    # a piece is what precedes a close; the break after the close before it is its first character
    spans = (f"aggregate(zip_with({pieces}, turns, (p, t) -> named_struct('n', length(p), 'loss', t.role <=> '{LOSS_ROLE}')), "
             "named_struct('at', 0L, 'spans', CAST(array() AS array<struct<start:bigint,end:bigint>>)), (acc, x) -> "
             f"named_struct('at', acc.at + x.n + {len(CLOSE)}, 'spans', CASE WHEN x.loss THEN concat(acc.spans, array(named_struct("
             f"'start', acc.at + CASE WHEN acc.at = 0 THEN 0 ELSE 1 END + {len(OPEN) + 1 + len(LOSS_ROLE) + 2}, 'end', acc.at + x.n))) "
             "ELSE acc.spans END), acc -> acc.spans)")
    return back.select("conv_id", "formatted", F.expr(spans).alias("loss_spans"), "turns",
                       F.expr("turns = source").alias("identical"))


def chat_report(formatted: DataFrame) -> DataFrame:
    """Digests of ``format_chat``'s rows, read back from the formatted text."""
    loss = f"array_join(transform(filter(turns, t -> t.role = '{LOSS_ROLE}'), t -> t.text), '')"
    said = "array_join(transform(turns, t -> concat(t.role, chr(10), t.text, chr(10))), '')"
    return formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.expr(said), 256).alias("turns_sha256"),
                            F.expr(loss).alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, 14 + length(role) + CASE WHEN contains(text, '\') OR contains(text, '</turn>') OR contains(text, '###')
  THEN length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '#', '\#')) ELSE length(text) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
