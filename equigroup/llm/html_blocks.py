"""Leaf blocks of an HTML page: their text and the tags above them.

A forgiving reader, since pages from the web are often broken: a tag that was
never closed ends with its parent, ``<p>`` and list or table parts end where the
next begins, and stray end tags are ignored. Scripts, styles, comments and
declarations are markup and never text; nothing else is left out. What stands in
``xmp`` is text as written; ``EMBEDDED`` elements are blocks like any other,
and a formula in ``math`` is text of its paragraph.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Fixed values of the HTML standard: which elements make blocks, are empty,
# hold raw text, or end an open paragraph, list item or table part.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option
p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
EMBEDDED = frozenset("noscript template iframe svg canvas object audio video noembed noframes xmp".split())
ENDS_P = BLOCK - frozenset("body button caption head html label legend optgroup option select td th tr tbody thead tfoot title textarea".split())
BLOCK |= EMBEDDED  # but they don't end a paragraph
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
         "option": ("select",), "optgroup": ("select",)}

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_MARK = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag and the words of its class, id and role, as parts of a tag path."""
    out = [tag]
    if attributes:
        for m in _MARK.finditer(attributes):
            out += [f".{w}" for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out)


class Path:
    """The open elements of a block as a chain, innermost first: ``up`` is what
    is around, None outside. Blocks share what is around them."""

    __slots__ = ("up", "marks")

    def __init__(self, up: Path | None, marks: tuple[str, ...]):
        self.up, self.marks = up, marks

    def __iter__(self):
        """The marks of each element, outermost first."""
        chain, at = [], self
        while at is not None:
            chain.append(at.marks)
            at = at.up
        return reversed(chain)


def along(path: Path | None, known: dict, start, step):
    """``step`` of the value around an element and the element, from the
    outermost (``start`` around it) to the innermost; ``known`` keeps the value
    of every element passed."""
    todo = []
    while path is not None and path not in known:
        todo.append(path)
        path = path.up
    value = start if path is None else known[path]
    for p in reversed(todo):
        value = known[p] = step(value, p)
    return value


def _markup(page: str):
    """(start, end, match of a tag or None) of each piece of markup, each
    character being read a fixed number of times: once a tag's quotes never
    close, no later quotes count, and past the last ``>`` all is text."""
    at, tag, last = 0, _TAG, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        m = _COMMENT.match(page, at)
        if m is None and at > last:
            at += 1
            continue
        t = None if m else tag.match(page, at)
        if t is None and m is None and tag is _TAG and (t := _LOOSE_TAG.match(page, at)):
            tag = _LOOSE_TAG
        m = m or t
        if m is None:
            at += 1
            continue
        at = (yield at, m.end(), t) or m.end()


def blocks(page: str) -> list[tuple[Path | None, str, float]]:
    """(tag path, text, share of the text inside links) of each block with text,
    in page order. A path has the marks of each open element. Time and memory
    grow with the page, however broken or deep it is."""
    out: list = []
    stack: list[tuple[str, Path | None]] = []  # open elements, each with its path
    places: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((stack[-1][1] if stack else None, text, min(1.0, linked / len(text))))
            buffer.clear()
        linked = 0

    def open_(tag: str, attributes: str) -> None:
        around, marks = stack[-1][1] if stack else None, _marks(tag, attributes)
        places[tag].append(len(stack))
        stack.append((tag, Path(around, marks) if tag in BLOCK or len(marks) > 1 else around))

    def close(at: int) -> None:
        """End the element at this depth and all inside it."""
        nonlocal links
        if any(stack[i][0] in BLOCK for i in range(at, len(stack))):
            flush()
        while len(stack) > at:
            tag, _ = stack.pop()
            places[tag].pop()
            links -= tag == "a"

    def deepest(names, scope=()) -> int | None:
        """Depth of the innermost open element of these names, unless one of
        ``scope`` is open inside it."""
        i = max((places[t][-1] for t in names if places[t]), default=-1)
        return i if i > max((places[t][-1] for t in scope if places[t]), default=-1) else None

    at, markup = 0, _markup(page)
    piece = next(markup, None)
    while piece:
        start, end, m = piece
        if start > at:
            buffer.append(page[at:start])
            if links:
                linked += len(page[at:start].strip())
        at, skip = end, None
        if m:
            tag, attributes = m[2].lower(), m[3]
            if m[1]:
                i = deepest((tag,), ("table",) if tag in ("p", "li") else ())
                if i is not None:
                    close(i)
                elif tag in BLOCK:
                    flush()
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    e = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                    at = skip = e.end() if e else len(page)
            else:
                if tag in ENDS_P and (i := deepest(("p",), ("button", "table", "caption", "td", "th"))) is not None:
                    close(i)
                if tag in ENDS:
                    while (i := deepest(ENDS[tag], SCOPE[tag])) is not None:
                        close(i)
                if tag in BLOCK:
                    flush()
                elif tag == "br":
                    buffer.append(" ")
                if tag == "xmp":  # what it holds is no markup
                    e = re.compile(r"</xmp\s*+>", re.I).search(page, at)
                    open_(tag, attributes)
                    buffer.append(page[at:e.start() if e else len(page)].replace("&", "&amp;"))
                    flush()
                    close(len(stack) - 1)
                    at = skip = e.end() if e else len(page)
                elif tag not in VOID and not (tag in EMBEDDED and attributes.rstrip().endswith("/")):
                    open_(tag, attributes)
                    links += tag == "a"
        try:
            piece = markup.send(skip)
        except StopIteration:
            break
    if at < len(page):
        buffer.append(page[at:])
        if links:
            linked += len(page[at:].strip())
    flush()
    return out
