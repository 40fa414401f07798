"""Turning whole texts into token ids inside Python tasks.

Every alternative of the byte-level split pattern that holds a character other
than white space ends at the next white space, so a place between the two is
always a boundary between matches. So is the end of a run of letters or number
signs where ASCII punctuation or white space follows, as no match holds both
(other followers may be letters to a newer Unicode than Python's). Texts are cut
there, so that words don't come with their punctuation, and each distinct piece
of a task is encoded once by the tokenizer's library; equal pieces are looked up.
Texts longer than ``SLICE`` are cut before white space first, which bounds the
list of pieces held at a time.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np

#: Characters of a text that are cut into pieces at a time.
SLICE = 1 << 20
#: Pieces kept for reuse by a task and the longest piece that is kept.
MAX_PIECES, MAX_PIECE_CHARS = 250_000, 64

#: The longest run of white space that the regex of tiktoken is given; from
#: about a million characters on it overflows its stack.
MAX_SPACE = 100_000

#: White space here is Python's; it also counts U+001C to U+001F, which the
#: tokenizers' patterns don't, so texts with those have patterns of their own.
_PIECE = re.compile(r" ?[^\W\d_]++(?![^\s!-/:-@[-`{-~])|\s*\S+|\s+")
_CUT = re.compile(r"(?<=\S)(?=\s)")
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = r"[^\S\x1c-\x1f]"
_ODD_PIECE = re.compile(rf"{_SPACE}*[\S\x1c-\x1f]+|{_SPACE}+")
_ODD_CUT = re.compile(rf"(?<=[\S\x1c-\x1f])(?={_SPACE})")
_LEAD = re.compile(f"{_SPACE}*")


def safe_slices(text: str, size: int = SLICE, where: re.Pattern = _CUT) -> Iterator[str]:
    """Consecutive parts of ``text`` of at least ``size`` characters (but the
    last), cut only where white space follows another character."""
    at = 0
    while len(text) - at > size:
        cut = where.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Known(dict):
    """text -> packed ids, worked out when first asked for and kept while
    there is room, since common texts come early; emptied when it has missed
    three times its room. Long texts are never kept."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = MAX_PIECES):
        super().__init__()
        self.encode, self.limit, self.missed = encode, limit, 0

    def __missing__(self, text: str) -> bytes:
        packed = self.encode(text)
        self.missed += 1
        if self.missed > 3 * self.limit:
            self.clear()
            self.missed = 0
        if len(self) < self.limit and len(text) <= MAX_PIECE_CHARS:
            self[text] = packed
        return packed


class PieceTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; ``encode``
    gives those of one piece. Texts are parted at the strings of ``added``
    first, which have the ids named there."""

    def __init__(self, encode: Callable[[str], bytes], max_pieces: int = MAX_PIECES, added: dict[str, int] | None = None):
        self.encode, self.known = encode, Known(encode, max_pieces)
        self.added = {s: pack_ids([i]) for s, i in (added or {}).items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def ids(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.plain_ids(text)
        return b"".join(self.added[t] if i % 2 else self.plain_ids(t) for i, t in enumerate(self.marks.split(text)) if t)

    def plain_ids(self, text: str) -> bytes:
        piece, cut = (_ODD_PIECE, _ODD_CUT) if _ODD.search(text) else (_PIECE, _CUT)
        return b"".join([b"".join(map(self.known.__getitem__, piece.findall(s))) for s in safe_slices(text, where=cut)])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def rank_encoding(rank_file: bytes, pattern: str):
    """A tiktoken encoding from the bytes of a rank file, without special tokens."""
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tiktoken_pieces(encoding) -> PieceTokenizer:
    """Pieces by the encoding's regex and merges. A long run of white space
    never meets the regex: by the pattern all of it but its last character is
    one match, or the whole run at the end of a text."""

    def encode(piece: str) -> bytes:
        if len(piece) > MAX_SPACE:
            run = _LEAD.match(piece).end()
            if run > MAX_SPACE:
                at = run if run == len(piece) else run - 1
                return pack_ids(encoding._encode_single_piece(piece[:at]) + encoding.encode_ordinary(piece[at:]))
        return pack_ids(encoding.encode_ordinary(piece))

    return PieceTokenizer(encode)


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def tokenizers_pieces(tokenizer_json: bytes, pattern: str, added_tokens: bool = False) -> PieceTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library. The library's
    BPE model encodes each match of the pattern; the matches of pieces with
    several are kept too, since pieces share them. With ``added_tokens`` the
    file's added tokens have their own ids wherever their strings stand in a
    text, as in the library's plain call; without, these strings are text (its ``encode_special_tokens``)."""
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json.decode("utf-8"))
    kind = json.loads(tok.pre_tokenizer.__getstate__())
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or tok.normalizer is not None:
        raise ValueError("a byte-level tokenizer without normalizer or added space is needed")
    added = tok.get_added_tokens_decoder() if added_tokens else {}
    if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError("added tokens that look at their neighbours are not supported")
    split, letters, model = regex.compile(pattern).findall, byte_letters(), tok.model

    def merged(match: str) -> bytes:
        return pack_ids([t.id for t in model.tokenize(match.encode("utf-8").decode("latin-1").translate(letters))])

    known = Known(merged)

    def encode(piece: str) -> bytes:
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():  # one match, as most pieces are
            return merged(piece)
        return b"".join(map(known.__getitem__, split(piece)))

    return PieceTokenizer(encode, added={t.content: i for i, t in added.items()})


def id_list(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()
