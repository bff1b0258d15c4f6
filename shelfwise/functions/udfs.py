"""Arrow functions for what column expressions cannot say."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from .dictionaries import ALIASES, DISPLAY, LANG_PREFIX
from .porter2 import stem
from .readme import opening
from .text import cap_bytes

_KNOWN = {*ALIASES, *DISPLAY, *ALIASES.values()}


@lru_cache(100_000)
def stem_term(term: str | None) -> str | None:
    """The stem; known terms and language terms stay. Words repeat, so their stems are remembered."""
    return term if term is None or term in _KNOWN or term.startswith(LANG_PREFIX) else stem(term)


def stemmed():
    """The stem of each term; made where it is used, as workers have no session."""

    @F.arrow_udf("string")
    def run(terms: pa.Array) -> pa.Array:
        return pa.array([stem_term(t) for t in terms.to_pylist()], pa.string())

    return run


def readme_opening(max_words: int = 120, max_bytes: int = 8192):
    @F.arrow_udf("string")
    def reduced(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cap_bytes(opening(t, max_words), max_bytes) for t in texts.to_pylist()], pa.string())

    return reduced
