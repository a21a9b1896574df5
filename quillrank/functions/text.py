"""Text and structure measures as column expressions.

All cuts follow Python slice rules on character positions; ``exact=True``
keeps the "not found still cuts" behaviour of the original measures.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions import patterns as P


def python_left(s: Column, k: Column) -> Column:
    """``s[0:k]`` with Python's negative-stop meaning."""
    n = F.when(k >= 0, k).otherwise(F.length(s) + k)
    return F.left(s, F.greatest(n, F.lit(0)))


def body_cut(content: Column, exact: bool = True) -> Column:
    """Text before the notes marker, minus one more character.

    i = 0-based find of the marker (-1 if absent); body = content[0:i-1].
    With ``exact=False`` an absent marker keeps the whole text.
    """
    pos = F.locate(P.NOTES_MARKER, content)  # 1-based, 0 when absent
    cut = python_left(content, pos - 2)
    if exact:
        return cut
    return F.when(pos > 0, cut).otherwise(content)


def strip_back_matter(text: Column, exact: bool = True) -> Column:
    """Fold the 12 back-matter markers, cutting the text at each one found.

    A marker that is absent still drops one trailing character when
    ``exact=True`` (slice to -1). One ``aggregate`` keeps the plan linear.
    """
    markers = F.array(*[F.lit(m) for m in P.BACK_MATTER_MARKERS])

    def step(acc: Column, m: Column) -> Column:
        pos = F.position(m, acc)
        if exact:
            keep = F.when(pos > 0, pos - 1).otherwise(F.length(acc) - 1)
        else:
            keep = F.when(pos > 0, pos - 1).otherwise(F.length(acc))
        return F.left(acc, F.greatest(keep, F.lit(0)))

    # Every marker starts with "== ": a text without it has none of them, and
    # the fold reduces to dropping one character per marker (or nothing).
    fast = F.left(text, F.greatest(F.length(text) - len(P.BACK_MATTER_MARKERS), F.lit(0))) if exact else text
    return F.when(F.position(F.lit("== "), text) > 0, F.aggregate(markers, text, step)).otherwise(fast)


def ws_to_space(s: Column) -> Column:
    """Map every whitespace character to ' ' so later patterns stay ASCII-simple.

    A Java regex over the wide Unicode whitespace class is several times slower
    than ``[^ ]+``; one translate pass is cheap.
    """
    return F.translate(s, P.WS_CHARS, " " * len(P.WS_CHARS))


def word_count(s: Column, normalized: bool = False) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    n = s if normalized else ws_to_space(s)
    return F.regexp_count(n, F.lit("[^ ]+")).cast("long")


def non_ws_chars(s: Column, normalized: bool = False) -> Column:
    """Sum of word lengths = characters that are not whitespace."""
    n = s if normalized else ws_to_space(s)
    return F.length(F.replace(n, F.lit(" "), F.lit(""))).cast("long")


def dot_count(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))).cast("long")


def sentence_piece_words(s: Column, normalized: bool = False) -> Column:
    """Total words over all '.'-pieces = words with '.' as an extra separator."""
    n = s if normalized else ws_to_space(s)
    return F.regexp_count(n, F.lit("[^ .]+")).cast("long")


def section_count(content: Column) -> Column:
    """Non-overlapping occurrences of '\\n\\n==' plus one."""
    return F.size(F.split(content, P.SECTION_SEP, -1)).cast("long")


def array_median(arr: Column) -> Column:
    """Median of a numeric array (mean of the middle two for even sizes)."""
    s = F.sort_array(arr)  # native ordering; array_sort runs an interpreted comparator
    n = F.size(s)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo.cast("double") + hi.cast("double")) / 2.0)


def sentence_lengths(body: Column, normalized: bool = False) -> Column:
    n = body if normalized else ws_to_space(body)
    return F.transform(F.split(n, "[.]", -1), lambda p: F.regexp_count(p, F.lit("[^ ]+")))


def word_lengths(body: Column, normalized: bool = False) -> Column:
    n = body if normalized else ws_to_space(body)
    return F.transform(F.regexp_extract_all(n, F.lit("[^ ]+"), 0), lambda w: F.length(w))


def filtered_word_count(body: Column, normalized: bool = False) -> Column:
    """Words other than the fixed stop tokens."""
    stops = F.array(*[F.lit(t) for t in P.WORD_STOP_TOKENS])
    words = F.regexp_extract_all(body if normalized else ws_to_space(body), F.lit("[^ ]+"), 0)
    return F.size(F.filter(words, lambda w: ~F.array_contains(stops, w))).cast("long")
