r"""Personal data in texts, DataFrame functions only.

Regular expressions propose spans; validators confirm them (digit sums and
Luhn for cards, mod-97 for account numbers, ranges and digit counts for
addresses and phones); words near a span raise its score. A span is reported
from a score of ``THRESHOLD`` on. Offsets are code points, ends exclusive.

A kind's matches are leftmost and non-overlapping. Their places follow from the
texts between them: ``split`` gives those and ``regexp_extract_all`` the
matches. The patterns are written so that each runs in linear time and stack: a
run of characters is entered only at its start or where the last match ended
(``\G``), which finds the same matches as trying every character, and
repetitions give nothing back where nothing that follows could use it.

Places are running sums over blocks of matches, and what stands beside a span is
cut from a text's pieces of ``CHUNK`` characters, so a text with very many
matches costs little more than as many short ones.

Defined cases: null and empty texts have no span; very long texts are searched
whole; repeated rows are reported each; the spans of one kind don't overlap,
those of different kinds may; extra columns are not read, or carried whole by
``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import id_text, let, pack_rows

THRESHOLD = 0.5
#: Characters before and after a span that are searched for context words.
NEAR = 40

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: SQL over a match, ``@v``. For mod-97 the first four characters go last and
#: letters count 10 to 35; the remainder has to be 1.
_DIGITS = "regexp_replace(@v, '[^0-9]', '')"
_MOD97 = ("aggregate(split(concat(substring(c, 5), substring(c, 1, 4)), ''), 0, (a, x) -> CASE WHEN x = '' THEN a "
          "WHEN x <= '9' THEN (a * 10 + int(x)) % 97 ELSE (a * 100 + int(conv(x, 36, 10))) % 97 END) = 1")


@dataclass(frozen=True)
class Kind:
    """``hint``: a cheap test that holds for every text with a match; ``check``:
    SQL over the match; ``score`` alone and ``near`` added where one of the
    context ``words`` is beside it."""

    name: str
    pattern: str
    hint: str
    check: str
    score: float
    near: float
    words: str


#: The first four are the base kinds: their valid matches are always reported.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "contains(t, '@')", "true", 0.9, 0.1, "mail|contact|write|escrib|schreib"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "digits",
         f"@v RLIKE '^{_BYTE}(?:[.]{_BYTE}){{3}}$'", 0.7, 0.2, "ip|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "digits",
         f"length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS})", 0.8, 0.2,
         "card|visa|credit|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')",
         f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, 0.2, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         "digits", f"exists(array(replace(@v, ' ', '')), c -> length(c) BETWEEN 15 AND 34 AND {_MOD97})", 0.8, 0.2,
         "iban|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits",
         "NOT @v RLIKE '^(?:000|666|9)|-00-|-0000$'", 0.3, 0.4, "ssn|social|security"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", "digits",
         "true", 0.2, 0.5, "token|secret|password|passwd|api.?key"),
)
BASE = 4

_SPANS = "array<struct<start:bigint,end:bigint,no:int,kind:string,score:double>>"
#: Code points of a piece of a text that is cut at many places.
CHUNK = 256


def _before(values: str, op: str) -> str:
    """SQL: for each of an array of longs, ``op`` of 0 and all before it. Blocks
    of the root of their number are run through one by one, so that n values
    take n * sqrt(n) steps of copying a long."""
    def run(xs: str, start: str) -> str:
        return (f"aggregate({xs}, named_struct('at', {start}, 'seen', CAST(array() AS array<bigint>)), "
                f"(acc, x) -> named_struct('at', {op.format('acc.at', 'x')}, 'seen', concat(acc.seen, array(acc.at))), acc -> acc.seen)")
    block = "slice(ns, int(j * root + 1), root)"
    whole = f"transform(sequence(0, (size(ns) - 1) div root), j -> aggregate({block}, 0L, (a, x) -> {op.format('a', 'x')}))"
    return let("ns", values, "CASE WHEN size(ns) = 0 THEN ns ELSE " + let("root", "int(ceil(sqrt(size(ns))))", (
        f"flatten(transform({run(whole, '0L')}, (o, j) -> {run(block, 'o')}))")) + " END")


def _chunks(text: str) -> str:
    """SQL: the text as pieces of ``CHUNK`` code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def _cut(chunks: str, start: str, end: str) -> str:
    """SQL: the code points from start up to end, from the pieces they lie in."""
    pieces = f"slice({chunks}, int({start} div {CHUNK} + 1), int(({end} - 1) div {CHUNK} - {start} div {CHUNK} + 1))"
    return (f"CASE WHEN {end} <= {start} THEN '' ELSE "
            f"substring(array_join({pieces}, ''), int({start} % {CHUNK} + 1), int({end} - {start})) END")


def _kind_spans(k: Kind, number: int) -> str:
    """SQL for the spans of one kind (_SPANS) over the columns t (text) and
    digits (whether it has any)."""
    found = let("vs", f"regexp_extract_all(t, r'{k.pattern}', 0)", f"CASE WHEN size(vs) = 0 THEN CAST(array() AS {_SPANS}) ELSE "
                + let("ls", f"zip_with(slice(split(t, r'{k.pattern}', -1), 1, size(vs)), vs, (gap, v) -> "
                      "named_struct('v', v, 'gap', bigint(length(gap)), 'n', bigint(length(v))))", let(
                          "good", "filter(zip_with(ls, " + _before("transform(ls, l -> l.gap + l.n)", "{0} + {1}")
                          + ", (l, b) -> named_struct('v', l.v, 'start', b + l.gap, 'end', b + l.gap + l.n)), "
                          f"s -> {k.check.replace('@v', 's.v')})", "CASE WHEN size(good) = 0 THEN CAST(array() AS "
                          f"{_SPANS}) ELSE @rated END")) + " END")
    beside = (_cut("cs", f"greatest(s.start - {NEAR}, 0L)", "s.start") + ", " + _cut("cs", "s.end", f"least(s.end + {NEAR}, total)"))
    near = f"CASE WHEN lower(concat_ws('\n', {beside})) RLIKE '(?<![a-z])(?:{k.words})' THEN {k.near}D ELSE 0D END"
    rated = let("cs", _chunks("t"), let("total", "bigint(length(t))", (
        "filter(transform(good, s -> named_struct('start', s.start, 'end', s.end, "
        f"'no', {number}, 'kind', '{k.name}', 'score', {k.score}D + {near})), s -> s.score >= {THRESHOLD}D)")))
    return f"CASE WHEN {k.hint} THEN {found.replace('@rated', rated)} ELSE CAST(array() AS {_SPANS}) END"


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` plus t (the text, null as empty) and spans: array of (start,
    end, no, kind, score), by start and then kind."""
    hinted = rows.withColumn("t", F.coalesce(text.cast("string"), F.lit(""))).withColumn("digits", F.col("t").rlike("[0-9]"))
    kinds = ", ".join(_kind_spans(k, i) for i, k in enumerate(KINDS))
    order = ("(a, b) -> CASE WHEN a.start <> b.start THEN int(sign(a.start - b.start)) ELSE a.no - b.no END")
    return hinted.withColumn("spans", F.expr(f"array_sort(concat({kinds}), {order})")).drop("digits")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans (array of start, end, no, kind, score)."""
    return with_spans(id_text(docs, id_col, text_col), F.col("text")).select("doc_id", "spans")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, base_sha256 and spans as text (kind:start:end)."""
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = [F.expr(f"CAST(size(filter(spans, s -> s.no = {i})) AS bigint)").alias(f"n_{k.name}")
             for i, k in enumerate(KINDS[:BASE])]
    return find_pii(docs, id_col, text_col).select(
        "doc_id", *count, F.sha2(F.expr(listed.format(f"filter(spans, s -> s.no < {BASE})")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with each span's text replaced by its kind in angle brackets
    (overlapping spans by that of the first) and, where the column is there,
    the number of code points brought up to date. Other columns stay; so do
    texts without a span, null included."""
    found = with_spans(docs.select(pack_rows(docs)), F.col("row").getField(text_col))
    ends = _before("transform(spans, s -> s.end)", "greatest({0}, {1})")
    filled = ("array_join(transform(zip_with(spans, prior, (s, b) -> named_struct('s', s, 'b', b)), p -> CASE WHEN p.s.start >= p.b THEN concat("
              + _cut("cs", "p.b", "p.s.start") + ", '<', p.s.kind, '>') ELSE '' END), '')")
    rest = let("last", "array_max(transform(spans, s -> s.end))", _cut("cs", "last", "bigint(length(t))"))
    clean = F.expr("CASE WHEN size(spans) = 0 THEN t ELSE " + let("cs", _chunks("t"), let("prior", ends, f"concat({filled}, {rest})")) + " END")
    out = found.withColumn("_clean", clean).withColumn("_hit", F.size("spans") > 0)
    cols = []
    for f in docs.schema.fields:
        own = F.col("row").getField(f.name)
        if f.name == text_col:
            own = F.when(F.col("_hit"), F.col("_clean")).otherwise(own)
        elif f.name == n_chars_col:
            own = F.when(F.col("_hit"), F.length("_clean").cast(f.dataType)).otherwise(own)
        cols.append(own.alias(f.name))
    return out.select(*cols)
