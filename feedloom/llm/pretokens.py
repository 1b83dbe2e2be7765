"""Cutting a text into the pre-tokens of byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

#: A place where every pre-token pattern of this family begins a new token: one space between two characters that are none.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
#: Ranges of letters and digits that came after Unicode 16. The tokenizer libraries know none of them; the regex module does.
NEWER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
    11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA
    18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
    1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_CLASS = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split())
_NEWER = regex.compile(f"[{_CLASS}]")


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The pattern, and the same with letters and digits as of Unicode 16, which is slower."""
    older = pattern
    for kind in (r"\p{L}", r"\p{N}"):
        older = older.replace(kind, f"[{kind}--[{_CLASS}]]")
    return regex.compile(pattern), regex.compile("(?V1)" + older)


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All pre-tokens of a text, as the tokenizer libraries cut them."""
    plain, older = _compiled(pattern)

    def find(text: str) -> list[str]:
        return (plain if text.isascii() or not _NEWER.search(text) else older).findall(text)

    return find


def chunks(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about `limit` characters, cut where no pre-token crosses, so that long texts need bounded memory."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text
