"""Configurable per-page feature extraction in one narrow plan.

Intermediate columns (body, stripped text, readability counts) are added in
their own projection so each is computed once per row; Catalyst does not
collapse a projection whose expensive output is used several times. No
shuffle: every measure is a row-local expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import readability as R
from quillrank.functions import text as T

# The stored feature columns, in table order.
FEATURE_TABLE_COLUMNS = [
    "meanWordLength", "meanSentLength", "nChars", "nImages", "nLinks", "nSections", "nSents",
    "nRefs", "nWordsSummary", "pageId", "revisionId", "title", "url", "reading_ease", "grade_level",
    "ColemanLiauIndex", "GunningFogIndex", "ARI", "SMOGIndex", "flags", "flagged", "featured", "score",
]
MEASURE_COLUMNS = [c for c in FEATURE_TABLE_COLUMNS if c not in ("flags", "flagged", "featured", "score")]
OPTIONAL_MEASURES = ["nWords", "medianSentLength", "medianWordLength"]
READABILITY = list(R.INDEX_BUILDERS)


def extract_features(records: DataFrame, columns: list[str] | None = None, exact: bool = True,
                     keep: list[str] | None = None, readability_guard: bool = True) -> DataFrame:
    """PageRecord → one row per page with the requested measures.

    ``columns`` picks from MEASURE_COLUMNS + OPTIONAL_MEASURES (default: all
    stored measures). ``keep`` lists record columns passed through (``id`` is
    always kept). Pages whose text is too short (no-text guard, X3) get 0 for
    the sentence/word/char measures and null indices. ``readability_guard``
    says whether the stored configuration measures readability (it does by
    default); then a page whose stripped text is <= 5 characters is no-text
    too, whichever subset of columns this call asks for.
    """
    columns = list(columns or MEASURE_COLUMNS)
    record_cols = ["id", "page_id", "revision_id", "url", "title", "content", "summary", "links", "images", "references"]
    keep = [c for c in (keep or []) if c not in record_cols]
    wants_read = readability_guard or any(c in READABILITY for c in columns)

    base = records.select(
        *record_cols, *keep,
        T.body_cut(F.col("content"), exact).alias("_body"),
        (T.strip_back_matter(F.col("content"), exact) if wants_read else F.lit(None).cast("string")).alias("_stripped"),
    )
    base = base.withColumn("_nbody", T.ws_to_space(F.col("_body")))
    no_text = F.coalesce(F.length("content"), F.lit(0)) < 5
    if wants_read:
        no_text = no_text | (F.coalesce(F.length("_stripped"), F.lit(0)) <= 5)
        base = base.withColumn("_toks", R.read_tokens(F.col("_stripped")))
        base = base.withColumn("_syl", R.syllables(F.col("_toks")))
        rc = R.readability_counts(F.col("_stripped"), F.col("_toks"), F.col("_syl"))
    else:
        rc = F.lit(None)
    stage2 = base.select(
        "*",
        no_text.alias("_no_text"),
        rc.alias("_rc"),
        T.word_count(F.col("_nbody"), normalized=True).alias("_nw"),
        T.dot_count(F.col("_body")).alias("_dots"),
    )

    body = F.col("_body")
    nt = F.col("_no_text")
    zero_if = lambda v, z=0: F.when(nt, F.lit(z)).otherwise(v)
    nsents = F.col("_dots") + 1
    exprs = {
        "nSents": zero_if(nsents).cast("long"),
        "meanSentLength": zero_if(T.sentence_piece_words(F.col("_nbody"), normalized=True) / nsents, 0.0).cast("double"),
        "medianSentLength": zero_if(T.array_median(T.sentence_lengths(F.col("_nbody"), normalized=True)), 0.0).cast("double"),
        "nWords": T.filtered_word_count(F.col("_nbody"), normalized=True),
        "meanWordLength": zero_if(F.when(F.col("_nw") > 0, T.non_ws_chars(F.col("_nbody"), normalized=True) / F.col("_nw")), 0.0).cast("double"),
        "medianWordLength": zero_if(T.array_median(T.word_lengths(F.col("_nbody"), normalized=True)), 0.0).cast("double"),
        "nChars": zero_if(F.length(F.translate(body, "\n=", ""))).cast("long"),
        "nWordsSummary": T.word_count(F.col("summary")),
        "nImages": F.coalesce(F.size("images"), F.lit(0)).cast("long"),
        "nLinks": F.coalesce(F.size("links"), F.lit(0)).cast("long"),
        "nRefs": F.coalesce(F.size("references"), F.lit(0)).cast("long"),
        "nSections": T.section_count(F.col("content")),
        "pageId": F.col("page_id"),
        "revisionId": F.col("revision_id"),
        "title": F.col("title"),
        "url": F.col("url"),
    }
    for name, build in R.INDEX_BUILDERS.items():
        exprs[name] = F.when(~nt, build(F.col("_rc")))
    unknown = [c for c in columns if c not in exprs]
    if unknown:
        raise ValueError(f"unknown feature columns: {unknown}")
    return stage2.select("id", *keep, *[exprs[c].alias(c) for c in columns])
