"""Readability indices from one fixed tokenizer.

Counts: W words, S sentences, Y syllables, P words with >= 3 syllables,
C letters (characters in words). The formulas are the published ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions import patterns as P


def read_tokens(text: Column) -> Column:
    """Lower-cased word tokens of the readability tokenizer.

    An inner apostrophe or hyphen is one private character in a token, so
    counts and lengths are those of ``READ_WORD``.
    """
    plain = F.replace(F.lower(text), F.lit(P.READ_JOINED), F.lit(" "))
    return F.regexp_extract_all(F.regexp_replace(plain, P.READ_JOINER, P.READ_JOINED), F.lit(P.READ_JOINED_WORD), 0)


def silent_e(w: Column) -> Column:
    """READ_SILENT_E without a regex: ends in 'e' after a character outside SILENT_E_KEEP."""
    prev = F.substring(w, -2, 1)
    return w.endswith("e") & (F.length(w) >= 2) & ~prev.isin(*P.SILENT_E_KEEP)


def syllables(toks: Column) -> Column:
    """Per-token syllable estimate: vowel groups, minus a silent final e, at least 1."""
    return F.transform(
        toks,
        lambda w: F.greatest(
            F.lit(1),
            F.regexp_count(w, F.lit(P.READ_VOWEL_GROUP)) - F.when(silent_e(w), 1).otherwise(0),
        ),
    )


def readability_counts(text: Column, toks: Column, syl: Column) -> Column:
    """struct(W, S, Y, P, C); ``toks``/``syl`` come from earlier projections."""
    return F.struct(
        F.size(toks).cast("long").alias("W"),
        F.greatest(F.lit(1), F.regexp_count(text, F.lit(P.READ_SENT_END))).cast("long").alias("S"),
        F.aggregate(syl, F.lit(0).cast("long"), lambda a, s: a + s).alias("Y"),
        F.size(F.filter(syl, lambda s: s >= 3)).cast("long").alias("P"),
        F.length(F.array_join(toks, "")).cast("long").alias("C"),
    )


def _ratios(c: Column):
    w = c["W"].cast("double")
    s = c["S"].cast("double")
    y = c["Y"].cast("double")
    p = c["P"].cast("double")
    ch = c["C"].cast("double")
    return w, s, y, p, ch


def _guard(c: Column, value: Column) -> Column:
    return F.when(c["W"] > 0, value)


def grade_level(c: Column) -> Column:
    w, s, y, _, _ = _ratios(c)
    return _guard(c, F.lit(0.39) * (w / s) + F.lit(11.8) * (y / w) - F.lit(15.59))


def reading_ease(c: Column) -> Column:
    w, s, y, _, _ = _ratios(c)
    return _guard(c, F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (y / w))


def ari(c: Column) -> Column:
    w, s, _, _, ch = _ratios(c)
    return _guard(c, F.lit(4.71) * (ch / w) + F.lit(0.5) * (w / s) - F.lit(21.43))


def coleman_liau(c: Column) -> Column:
    w, s, _, _, ch = _ratios(c)
    return _guard(c, F.lit(5.88) * (ch / w) - F.lit(29.6) * (s / w) - F.lit(15.8))


def gunning_fog(c: Column) -> Column:
    w, s, _, p, _ = _ratios(c)
    return _guard(c, F.lit(0.4) * ((w / s) + F.lit(100.0) * (p / w)))


def smog(c: Column) -> Column:
    _, s, _, p, _ = _ratios(c)
    return _guard(c, F.lit(1.043) * F.sqrt(F.lit(30.0) * (p / s)) + F.lit(3.1291))


INDEX_BUILDERS = {
    "grade_level": grade_level,
    "reading_ease": reading_ease,
    "ColemanLiauIndex": coleman_liau,
    "GunningFogIndex": gunning_fog,
    "ARI": ari,
    "SMOGIndex": smog,
}
