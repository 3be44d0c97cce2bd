"""Pre-tokens of byte-level BPE: the runs that `public_tokenizers.PATTERN` cuts a text into."""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
import regex

# Letters, numbers and white space of U+0000 to U+02AF, the block of Latin scripts.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = r"\t-\r \x85\xa0"

_BEYOND_LATIN = re.compile("[^\x00-ʯ]")
_LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


@lru_cache(maxsize=1)
def _any_script() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def is_latin(text: str) -> bool:
    return _BEYOND_LATIN.search(text) is None


def split_latin(text: str) -> list[str]:
    """The matches of PATTERN in a text for which `is_latin` holds, by explicit character classes (several times faster)."""
    return _LATIN.findall(text)


def split(text: str) -> list[str]:
    """The matches of PATTERN in any text."""
    return _LATIN.findall(text) if is_latin(text) else _any_script().findall(text)
