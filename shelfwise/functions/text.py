"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import ALIASES, DISPLAY, LANG_PREFIX, STOPWORDS

NOT_WORD = r"[^\p{L}\p{Nd}]+"
# Fixed behaviour, as (pattern, what it becomes, strings a text must hold for it to match).
# Bounds of spellings are ASCII: JVM word boundaries take accented letters for word characters.
_SPELLINGS = [
    (r"(?i)(?<![0-9A-Za-z_])c\+\+(?![0-9A-Za-z_])", "cpp", ("++",)),
    (r"(?i)(?<![0-9A-Za-z_])c#(?![0-9A-Za-z_])", "csharp", ("c#", "C#")),
    (r"(?i)(?<![0-9A-Za-z_])f#(?![0-9A-Za-z_])", "fsharp", ("f#", "F#")),
    (r"(?i)(?<![0-9A-Za-z_])\.net(?![0-9A-Za-z_])", "dotnet", (".n", ".N")),
    (r"(?i)(?<![0-9A-Za-z_])node\.js(?![0-9A-Za-z_])", "nodejs", (".j", ".J")),
]
# An address is a whole run of non-spaces with :// inside; a match begins where a run does, so
# that long runs are read once.
_MARKUP = [
    (r"!\[[^\]]*\]\([^)]*\)", " ", ("](",)),
    (r"\[([^\]]*)\]\([^)]*\)", " $1 ", ("](",)),
    (r"<[a-zA-Z/!][^>]*>", " ", (">",)),
    (r"(?<!\S)\S+?://\S+|(?<![0-9A-Za-z_])www\.\S+", " ", ("://", "www.")),
]
# Between lower|Upper and Upper|Upper lower.
_CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
_MARK = "\x01"  # no letter and no digit


def replaced(s: Column, rules: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """Regular expression replacements in turn, each only in texts that hold one of its strings."""
    def rule(pattern: str, to: str, marks: tuple[str, ...]):
        return lambda x: F.when(_holds(x, marks), F.regexp_replace(x, pattern, to)).otherwise(x)

    for r in rules:  # a lambda names its text, which is so written and evaluated once, however many rules follow
        s = F.transform(F.array(s), rule(*r))[0]
    return s


def _holds(s: Column, marks: tuple[str, ...]) -> Column:
    out = F.contains(s, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(s, F.lit(m))
    return out


def owner(full_name: Column) -> Column:
    """Before the first slash; empty without one, or when it comes first."""
    return F.when(F.instr(full_name, "/") > 1, F.substring_index(full_name, "/", 1)).otherwise(F.lit(""))


def name(full_name: Column) -> Column:
    """After the first slash; the whole without one."""
    at = F.instr(full_name, "/")
    return F.when(at > 1, full_name.substr(at + 1, F.length(full_name))).otherwise(full_name)


def spell(s: Column) -> Column:
    """Language names with signs, in letters: C++, C#, F#, .NET, Node.js."""
    return replaced(s, _SPELLINGS)


def clean(s: Column) -> Column:
    """Without images, links (their text stays), tags and addresses; then `spell`."""
    return replaced(s, [*_MARKUP, *_SPELLINGS])


def camel_words(s: Column) -> Column:
    """The camel parts of a text's words, in order; known words stay whole.

    Boundaries are marked in one pass over the text, and only words with a mark are split.
    """
    marked = F.regexp_replace(F.translate(s, _MARK, " "), _CAMEL, _MARK)
    whole = F.filter(F.split(marked, rf"[^\p{{L}}\p{{Nd}}{_MARK}]+"), lambda w: w != "")

    def parts(w: Column) -> Column:
        joined = F.translate(w, _MARK, "")
        return F.when(F.contains(w, F.lit(_MARK)), F.when(known(joined), F.array(joined)).otherwise(F.split(w, _MARK))).otherwise(F.array(w))

    return F.flatten(F.transform(whole, parts))


def language_term(language: Column) -> Column:
    """lang: and the letters and digits of the spelled name; null when nothing is left."""
    bare = F.regexp_replace(spell(F.lower(F.trim(language))), NOT_WORD, "")
    return F.when(bare != "", F.concat(F.lit(LANG_PREFIX), bare))


def canonical_topic(topic: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(topic)), NOT_WORD, "-"), "^-+|-+$", "")


def camel_parts(word: Column) -> Column:
    """Parts at lower|Upper and at Upper|Upper lower."""
    return F.split(word, _CAMEL)


def known(word: Column) -> Column:
    """Whether the lower-cased word is a term of its own and is not split."""
    return F.lower(word).isin(sorted({*ALIASES, *DISPLAY}))


def normalized(word: Column) -> Column:
    """The term of a word before stemming, or null: length in bytes, alias, stopword, number."""
    term = aliased(F.lower(word))
    drop = term.isin(STOPWORDS) | term.rlike(r"^v?\p{Nd}+$")
    return F.when(F.octet_length(F.lower(word)).between(2, 24) & ~drop, term)


def aliased(word: Column) -> Column:
    """The term that a lower-case word stands for, or the word itself."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(word.isin(sorted(ALIASES)), F.element_at(table, word)).otherwise(word)


def first_words(s: Column, n: int) -> Column:
    """The first n words joined by single spaces; n <= 0 leaves the text as it is."""
    if n <= 0:
        return s
    return F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, n), " ")


def glob_pattern(glob: str) -> str:
    """Shell glob as an anchored regular expression; * and ? stop at a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] == "^" else i + 1)
            if end < 0:
                raise ValueError(f"malformed pattern {glob!r}")
            out += glob[i : end + 1]
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                raise ValueError(f"malformed pattern {glob!r}")
            i += 1
            out += "\\" + glob[i]
        else:
            out += "\\" + c if not c.isalnum() and c not in "/_ -" else c
        i += 1
    return f"^(?:{out})$"


def matches_glob(full_name: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        p = glob_pattern(g)
        hit = hit | full_name.rlike(p) | name(full_name).rlike(p)
    return hit


def rounded(x: Column) -> Column:
    """Three decimals, truncated after adding a half: -0.5 becomes -0.499."""
    return ((x * 1000 + 0.5).cast("long") / 1000).cast("double")


def truncated(s: Column, n: int) -> Column:
    """The first n characters, without white space at the ends."""
    return F.trim(F.substring(s, 1, n), F.lit(" \t\n\r"))


def one_line(s: Column) -> Column:
    """Line breaks as spaces, without white space at the ends."""
    return F.trim(F.translate(s, "\n\r", "  "), F.lit(" \t"))


def stars(n: Column) -> Column:
    """A count for an index: nothing up to 0, as it is below 1000, else thousands."""
    tenths = F.floor((n + 50) / 100)
    shown = F.when(n < 1000, n.cast("string")).otherwise(F.concat_ws(".", F.floor(tenths / 10).cast("string"), F.concat((tenths % 10).cast("string"), F.lit("k"))))
    return F.when(n > 0, F.concat(F.lit(" `★"), shown, F.lit("`"))).otherwise("")


def cap_bytes(s: str, limit: int) -> str:
    """At most `limit` bytes, cut after a word, or between characters of a long one."""
    data = s.encode()
    if limit <= 0 or len(data) <= limit:
        return s
    head = data[:limit].decode(errors="ignore")
    at = head.rfind(" ")
    return head[: at if at > 0 else len(head)].strip()
