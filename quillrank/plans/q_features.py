"""Registered queries: records, text measures, readability, labels (X, E, S2-S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators.features import extract_features
from quillrank.operators.labels import label_rows
from quillrank.plans import oracle as O
from quillrank.plans.corpus import (doc_feature_table, html_feature_table, labelled_doc_table,
                                     labelled_html_table, labels_table)
from quillrank.plans.registry import r6, register, round_doubles
from quillrank.sources import document_records, html_records, read_table

DOUBLE_TABLE_COLS = {"meanWordLength", "meanSentLength", "reading_ease", "grade_level", "ColemanLiauIndex",
                     "GunningFogIndex", "ARI", "SMOGIndex", "score", "medianSentLength", "medianWordLength"}


def _sql_cols(cols, alias=""):
    return ", ".join(r6(f"{alias}{c}") + f" AS {c}" if c in DOUBLE_TABLE_COLS else f"{alias}{c}" for c in cols)


# -- full tables -------------------------------------------------------------

@register("page_features", sql=f"WITH {O.doc_table()} SELECT id, {_sql_cols(O.TABLE_COLUMNS)} FROM tbl")
def page_features(spark, sf_dir):
    """X23 + E7 + J8: the stored feature table of the document corpus."""
    return round_doubles(doc_feature_table(spark, sf_dir))


@register("html_page_features", sql=f"WITH {O.html_table()} SELECT id, {_sql_cols(O.TABLE_COLUMNS)} FROM htbl")
def html_page_features(spark, sf_dir):
    """X23 over captured HTML pages, labelled through the article key."""
    return round_doubles(html_feature_table(spark, sf_dir))


@register("page_records", sql=f"""
SELECT id, page_id, revision_id, url, title, length(content) AS content_chars, md5(content) AS content_md5,
       summary, array_to_string(links, ' ') AS links, array_to_string(images, ' ') AS images,
       array_to_string(refs, ' ') AS refs
FROM ({O.HTML_RECORDS})""")
def page_records(spark, sf_dir):
    """Captured HTML → PageRecord (content shown by length and md5)."""
    r = html_records(spark, sf_dir)
    return r.select(
        "id", "page_id", "revision_id", "url", "title",
        F.length("content").cast("long").alias("content_chars"), F.md5(F.col("content")).alias("content_md5"),
        "summary", F.array_join("links", " ").alias("links"), F.array_join("images", " ").alias("images"),
        F.array_join("references", " ").alias("refs"),
    )


# -- single measures -----------------------------------------------------------

def _doc_measure(spark, sf_dir, cols):
    return round_doubles(extract_features(document_records(spark, sf_dir), cols))


def _doc_measure_sql(cols):
    return f"WITH {O.features_ctes(O.DOC_RECORDS, cols)} SELECT id, {_sql_cols(cols)} FROM feat"


def _measure_query(name, cols):
    @register(name, sql=_doc_measure_sql(cols))
    def q(spark, sf_dir):
        return _doc_measure(spark, sf_dir, cols)
    q.__name__ = name
    q.__doc__ = f"Per-document {', '.join(cols)} (whole texts, no-text guard applied)."
    return q


sentence_stats = _measure_query("sentence_stats", ["nSents", "meanSentLength"])          # X4, X5
median_lengths = _measure_query("median_lengths", ["medianSentLength", "medianWordLength"])  # X6, X9
word_stats = _measure_query("word_stats", ["nWords", "meanWordLength"])                   # X7, X8
char_stats = _measure_query("char_stats", ["nChars"])                                     # X10
section_count = _measure_query("section_count", ["nSections"])                            # X15
readability_grade = _measure_query("readability_grade", ["grade_level"])                  # X17
readability_ease = _measure_query("readability_ease", ["reading_ease"])                   # X18
readability_coleman_liau = _measure_query("readability_coleman_liau", ["ColemanLiauIndex"])  # X19
readability_gunning_fog = _measure_query("readability_gunning_fog", ["GunningFogIndex"])  # X20
readability_ari = _measure_query("readability_ari", ["ARI"])                              # X21
readability_smog = _measure_query("readability_smog", ["SMOGIndex"])                      # X22


_STRUCT = ["nWordsSummary", "nImages", "nLinks", "nRefs"]


@register("structure_counts", sql=f"WITH {O.features_ctes(O.HTML_RECORDS, _STRUCT)} SELECT id, {_sql_cols(_STRUCT)} FROM feat")
def structure_counts(spark, sf_dir):
    """X11-X14 on captured pages (they carry links)."""
    return extract_features(html_records(spark, sf_dir), _STRUCT)


@register("body_cut", sql=f"""
WITH {O.features_ctes(O.DOC_RECORDS, ['nSents'])}
SELECT id, CAST(length(_body) AS BIGINT) AS body_chars, md5(_body) AS body_md5 FROM f1""")
def body_cut(spark, sf_dir):
    """Text before the notes marker (length and md5 of the whole body)."""
    b = T.body_cut(F.col("content"))
    return document_records(spark, sf_dir).select(
        "id", F.length(b).cast("long").alias("body_chars"), F.md5(b).alias("body_md5"))


@register("strip_sections", sql=f"""
WITH {O.features_ctes(O.DOC_RECORDS, ['nSents'])}
SELECT id, CAST(length(_stripped) AS BIGINT) AS stripped_chars, md5(_stripped) AS stripped_md5 FROM f1""")
def strip_sections(spark, sf_dir):
    """Back-matter strip used for readability."""
    s = T.strip_back_matter(F.col("content"))
    return document_records(spark, sf_dir).select(
        "id", F.length(s).cast("long").alias("stripped_chars"), F.md5(s).alias("stripped_md5"))


_NOTEXT = ["nSents", "meanSentLength", "meanWordLength", "nChars", "grade_level", "reading_ease"]


@register("no_text_pages", sql=f"""
WITH {O.features_ctes(O.DOC_RECORDS, _NOTEXT)}
SELECT f.id, {_sql_cols(_NOTEXT, 'f.')} FROM feat f JOIN f2 ON f.id = f2.id WHERE f2._no_text""")
def no_text_pages(spark, sf_dir):
    """Pages caught by the no-text guard and the measures they get."""
    recs = document_records(spark, sf_dir)
    stripped = T.strip_back_matter(F.col("content"))
    guarded = recs.where((F.coalesce(F.length("content"), F.lit(0)) < 5) | (F.coalesce(F.length(stripped), F.lit(0)) <= 5))
    return round_doubles(extract_features(guarded, _NOTEXT))


# -- labels --------------------------------------------------------------------

@register("ingest_labels", sql=f"SELECT label_id, flags, coalesce(flagged0, false) AS flagged, featured0 AS featured, score FROM ({O.LABEL_ROWS})")
def ingest_labels(spark, sf_dir):
    """Label rule at intake (flags, flagged, featured, score)."""
    return label_rows(labels_table(spark, sf_dir))


@register("label_join", sql=f"""
WITH {O.html_table()}
SELECT id, pageId, title, flags, flagged, featured, {r6('score')} AS score FROM htbl WHERE flagged OR featured""")
def label_join(spark, sf_dir):
    """Captured pages that receive a featured / flagged mark from the labels."""
    t = labelled_html_table(spark, sf_dir, ["pageId", "title"])
    return round_doubles(t.select("id", "pageId", "title", "flags", "flagged", "featured", "score"))


@register("labelled_pages", sql=f"""
WITH {O.doc_table()}
SELECT id, pageId, flagged, featured, {r6('grade_level')} AS grade_level, nLinks, nWordsSummary
FROM tbl WHERE flagged OR featured""")
def labelled_pages(spark, sf_dir):
    """S3: the labelled subset (flagged = 1 OR featured = 1)."""
    t = labelled_doc_table(spark, sf_dir, ["pageId", "grade_level", "nLinks", "nWordsSummary"])
    return round_doubles(t.select("id", "pageId", "flagged", "featured", "grade_level", "nLinks", "nWordsSummary"))


@register("page_id_list", sql="SELECT doc_id AS page_id FROM documents ORDER BY page_id")
def page_id_list(spark, sf_dir):
    """The ordered page-id work list (range-partitioned sort)."""
    return read_table(spark, sf_dir, "documents", ["doc_id"]).select(F.col("doc_id").alias("page_id")).orderBy("page_id")
