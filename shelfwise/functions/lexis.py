"""Words and terms of cleaned texts in Python: what `camel_words` and `normalized` say, by distinct word."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache
from itertools import chain

from .dictionaries import ALIASES, DISPLAY, STOPWORDS

KEPT = 200_000  # words that a table remembers, and counts that a task holds, before they are let go
_KNOWN = {*ALIASES, *DISPLAY}
_STOP = set(STOPWORDS)
# Fixed patterns: runs of letters and decimal digits, by the characters a text holds.
_ASCII = re.compile("[0-9A-Za-z]+")
_LATIN = re.compile("[0-9A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_ANY = re.compile(r"[^\W_]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@cache
def _no_digits() -> dict[int, str]:
    """Numbers that are neither letters nor decimal digits; Python's \\w takes them in."""
    return {c: " " for c in range(sys.maxunicode + 1) if (x := chr(c)).isnumeric() and not x.isalpha() and not x.isdecimal()}


def split(text: str) -> list[str]:
    """Runs of letters and decimal digits, in order."""
    if text.isascii():
        return _ASCII.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text.translate(_no_digits()))
    return _LATIN.findall(text)


def parts(word: str) -> tuple[str, ...]:
    """The camel parts of a word; a known word stays whole."""
    if word.islower() or word.lower() in _KNOWN:
        return (word,)
    if word.isascii():
        return tuple(_CAMEL.split(word))
    kinds = [unicodedata.category(c) for c in word]
    cuts = [i for i in range(1, len(word)) if kinds[i] == "Lu" and (kinds[i - 1] == "Ll" or (kinds[i - 1] == "Lu" and kinds[i + 1 : i + 2] == ["Ll"]))]
    return tuple(word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True))


def term(raw: str) -> str | None:
    """The term of a part before stemming, or None: length in bytes, alias, stopword, number."""
    low = raw if raw.islower() else raw.lower()
    if not 2 <= (len(low) if low.isascii() else len(low.encode())) <= 24:
        return None
    out = ALIASES.get(low, low)
    number = out[-1].isdecimal() and (out[1:] if out[0] == "v" else out).isdecimal()
    return None if number or out in _STOP else out


class Table(dict):
    """What is made of a word, remembered for KEPT words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= KEPT:
            self.clear()
        out = self[word] = self.make(word)
        return out

    def of(self, text: str) -> list:
        """What is made of a text's words, in order."""
        return list(chain.from_iterable(map(self.__getitem__, split(text))))


def _terms(word: str) -> tuple[str, ...]:
    if word.islower():
        return () if (t := term(word)) is None else (t,)
    return tuple(t for p in parts(word) if (t := term(p)) is not None)


# One table for each worker, which reads many tasks.
@cache
def raws() -> Table:
    return Table(parts)


@cache
def terms() -> Table:
    return Table(_terms)


@cache
def pairs() -> Table:
    """(term, raw) of the parts that have a term."""
    return Table(lambda w: tuple((t, p) for p in parts(w) if (t := term(p)) is not None))
