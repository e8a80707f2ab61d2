"""Splitting texts for byte-level BPE, and the vocabulary file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import regex

#: The published split pattern of this family of vocabularies, with a place for the
#: letters L and the numbers N; and the code points that the regex module counts as letters or
#: numbers while the tokenizer library's older Unicode tables don't know them yet.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"""
UNKNOWN_RANGES = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f "
    "12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 "
    "1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: A pretoken list is cut at about this many characters of a long text.
SLICE_CHARS = 1 << 18


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabulary strings: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 0x100
    for b in range(256):
        if b in set(printable):
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


class Vocabulary:
    """Merge ranks of pairs of symbols, and the ids' byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text = {i: bytes(byte_of[ch] for ch in s) for s, i in ids.items() if s not in self.added}
        self.text |= {i: s.encode() for s, i in self.added.items()}
        self.byte_id = [ids[s] for s in byte_symbols()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: rank by (left id << 16 | right id); ids have at most 16 bits in these vocabularies
        assert max(ids.values()) < 1 << 16, "symbol ids need more than 16 bits"
        self.ranks = {ids[a] << 16 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        #: id of the merged symbol by rank
        self.merged = [ids[a + b] for a, b in pairs]
        self.split_added = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")")
            if self.added
            else None
        )


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pattern(unknown: str = "") -> str:
    letters, numbers = (rf"[\p{{{c}}}--[{unknown}]]" if unknown else rf"\p{{{c}}}" for c in "LN")
    if unknown:
        return "(?V1)" + PATTERN.replace("{L}", letters).replace("{N}", numbers)
    return PATTERN.replace("{L}", letters).replace("{N}", numbers)


def _unknown() -> str:
    ends = [r.split("-") for r in UNKNOWN_RANGES.split()]
    return "".join(f"\\U{int(r[0], 16):08x}-\\U{int(r[-1], 16):08x}" for r in ends)


#: The second gives the same, slowly, for texts that reach the first unknown code point.
_FIND, _FIND_ALL = regex.compile(_pattern()), regex.compile(_pattern(_unknown()))
_FIRST_UNKNOWN = chr(int(UNKNOWN_RANGES[:3], 16))
_OTHER_SPACE = {chr(c) for c in range(0x3001) if chr(c).isspace()} - {" "}
_CUT = re.compile(r"(?<=\S)(?= \S)")


def pretokens(piece: str) -> list[str]:
    if piece.isascii() or max(piece) < _FIRST_UNKNOWN:
        return _FIND.findall(piece)
    return _FIND_ALL.findall(piece)


def chunks(text: str) -> Iterator[list[str]]:
    """Cuts a text into parts whose pretokens don't depend on each other.

    A pretoken takes at most one space, in front, so a single space between two characters that are
    no white space always starts a new one. Yields lists of such parts, the space in front of each
    but the first; at other white space the parts stay joined.
    """
    start, n = 0, len(text)
    while start < n:
        stop = n
        if n - start > SLICE_CHARS:
            stop = start + SLICE_CHARS
            while True:
                stop = text.find(" ", stop)
                if stop < 0 or stop + 1 >= n:
                    stop = n
                    break
                if not text[stop - 1].isspace() and not text[stop + 1].isspace():
                    break
                stop += 1
        yield _parts(text[start:stop])
        start = stop


def _parts(text: str) -> list[str]:
    if "  " in text or any(c + " " in text or " " + c in text for c in _OTHER_SPACE.intersection(text)):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    parts = [" " + p for p in rest]
    return [first, *parts] if first else parts


def segments(text: str, vocab: Vocabulary) -> Iterator[tuple[str, bool]]:
    """The text between added strings, and those strings themselves (flag true)."""
    if vocab.split_added is None or not any(s in text for s in vocab.added):
        yield text, False
        return
    for k, piece in enumerate(vocab.split_added.split(text)):
        if piece:
            yield piece, k % 2 == 1
