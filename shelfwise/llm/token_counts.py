"""Token counts of a unigram tokenizer without making the tokens.

Aho-Corasick reports all vocabulary pieces that end at each character; a dynamic programme
carries the best score and the number of pieces up to there. Ties follow the tokenizer: of
equal scores the candidate that starts first stays; a character that no piece of its own
covers is an unknown with the least score minus 10, and falls back to its UTF-8 bytes. A
space starts a new unit and becomes U+2581; the text has one in front, unless it starts
with one. Units are
independent, and each distinct one is solved once by a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import others, shape_of, text_rows

MAX_KNOWN = 400_000
MARK = "▁"


@cache
def read_vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """(score by piece, whether all byte pieces exist) of a public piece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
    return plain, sum(map(sp.is_byte, ids)) == 256


class Counter:
    """Counts pieces of units by the best path."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True, penalty: float = 10.0):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.alphabet = {c for piece in scores for c in piece}
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - penalty
        self.byte_fallback = byte_fallback
        # whole scores add up without rounding, so paths may be split at characters in no piece
        self.exact = all(float(s).is_integer() for s in scores.values())
        self.known: dict[str, int] = {}

    def unit(self, s: str) -> int:
        """Pieces of the best path over `s`, taken as it is."""
        n = len(s)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        set_to = [False] * (n + 1)
        hits = self.auto.iter(s)
        ahead = next(hits, None)
        for e in range(1, n + 1):
            # longest first, that is in the order of their starts; ties keep the first
            here = []
            while ahead is not None and ahead[0] + 1 == e:
                here.append(ahead[1])
                ahead = next(hits, None)
            for length, score in sorted(here, reverse=True):
                b = e - length
                total = score + best[b]
                if not set_to[e] or total > best[e]:
                    best[e], count[e], unk[e], set_to[e] = total, count[b] + 1, False, True
            c = s[e - 1]
            if c not in self.single:
                total = self.unknown + best[e - 1]
                if not set_to[e] or total > best[e]:
                    more = len(c.encode()) if self.byte_fallback else (0 if unk[e - 1] else 1)
                    best[e], count[e], unk[e], set_to[e] = total, count[e - 1] + more, True, True
        return count[n]

    def text(self, s: str) -> int:
        """Tokens of a whole text; the empty text has none."""
        if not s:
            return 0
        s = s.replace(MARK, " ")
        known, total = self.known, 0
        if len(known) > MAX_KNOWN:
            known.clear()
        cut = self.exact and self.byte_fallback and "\n" not in self.alphabet
        lines = s.split("\n") if cut else [s]
        total += len(lines) - 1
        for k, line in enumerate(lines):
            head, *rest = line.split(" ")
            if k == 0:
                if s[0] != " ":
                    rest.insert(0, head)
            elif head:
                key = "\n" + head
                n = known.get(key)
                if n is None:
                    n = known[key] = self.unit(head)
                total += n
            for w in rest:
                n = known.get(w)
                if n is None:
                    n = known[w] = self.unit(MARK + w)
                total += n
        return total


@cache
def _counter(path: str) -> Counter:
    return Counter(*read_vocabulary(path))


def _count(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            *carried, texts = batch.columns
            n = [0 if (t := x.as_py()) is None else counter.text(t) for x in texts]
            yield pa.record_batch([*carried, pa.array(n, pa.int64())], names=names)

    return run


def with_token_counts(docs: DataFrame, model_path: str, text_col: str = "text", name: str = "n_tokens", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text and a namesake) and the token count of the whole text.

    Null and empty texts have 0 tokens; each row counts by itself, repeated rows alike; other
    columns may have any name. The vocabulary file must be readable at the same path on every
    machine, as a part of the installed environment.
    """
    carry = others(docs, text_col, name) if carry is None else carry
    shape = shape_of(docs, carry, {name: "long"})
    return text_rows(docs, text_col, carry).mapInArrow(_count(model_path, shape.names), shape)
