"""Title search (W5) and first usable candidate.

Search semantics: a phrase finds the titles that hold all of its tokens
(lower-cased letter/digit tokens), anywhere and in any order; the three
shortest such titles are returned, ties by id. Equal phrases are searched
once. Titles are probed by each phrase's rarest token only (counted by a
partial aggregation over the titles' tokens) and the other tokens are checked
on the candidates, which alone carry them; the window's limit leaves three rows
per phrase and task before the shuffle, so a very common token gathers nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources.tables import materialize

TOKEN = r"[\p{L}\p{N}]+"
TOP_K = 3


def tokens(title) -> "F.Column":
    """The distinct tokens of a title or phrase, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(TOKEN), 0)))


def search_titles(phrases: DataFrame, titles: DataFrame, phrase_id: str = "phrase_id", phrase_col: str = "phrase",
                  id_col: str = "id", title_col: str = "title", k: int = TOP_K) -> DataFrame:
    """(phrase_id, rank, doc_id) for up to ``k`` titles per phrase; no hit ⇒ no row."""
    p = phrases.select(F.col(phrase_id).alias("phrase_id"), tokens(F.col(phrase_col)).alias("wanted"))
    distinct = p.where(F.size("wanted") > 0).select("wanted").distinct()
    t = titles.select(F.col(id_col).alias("doc_id"), F.length(title_col).alias("tlen"), tokens(F.col(title_col)).alias("held"))
    asked = distinct.select("wanted", F.explode("wanted").alias("token"))
    # How often titles hold each token that some phrase asks for (counted in tasks before anything is dealt out).
    held = t.select(F.explode("held").alias("token")).groupBy("token").count()
    probe = (asked.join(held, "token").groupBy("wanted")
             .agg(F.min_by("token", F.struct("count", "token")).alias("token"), F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("wanted")).drop("n"))
    # Titles that hold a probed token are found by ids and tokens alone; only they take their tokens along, once for each probed one.
    probed = (t.select("doc_id", F.explode("held").alias("token")).join(probe.select("token").distinct(), "token", "left_semi")
              .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("token").alias("probed")))
    found = (t.join(probed, F.col("doc_id").eqNullSafe(F.col("_id")))
             .select("doc_id", "tlen", "held", F.explode(F.array_intersect("held", "probed")).alias("token")).join(probe, "token")
             .where(F.size(F.array_except("wanted", "held")) == 0).select("wanted", "tlen", "doc_id"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy("tlen", "doc_id"))).where(F.col("rank") <= k)
    return p.join(best, "wanted").select("phrase_id", F.col("rank").cast("int").alias("rank"), "doc_id")


def first_scored(hits: DataFrame, scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Per phrase, the best-ranked hit whose stored score is not null.

    ``min_by`` per phrase is a partially aggregated groupBy (no per-group
    collection).
    """
    s = scores.select(F.col("id").alias("doc_id"), F.col(score_col).alias("score")).where(F.col("score").isNotNull())
    j = hits.join(s, "doc_id")
    return (j.groupBy("phrase_id")
             .agg(F.min_by(F.struct("rank", "doc_id", "score"), F.col("rank")).alias("b"))
             .select("phrase_id", "b.rank", "b.doc_id", "b.score"))


def lookup_or_score(wanted: DataFrame, stored: DataFrame, score_missing: Callable[[DataFrame], DataFrame], key: str = "page_id") -> DataFrame:
    """(id, pageId, found, score) of wanted pages, stored scores first.

    ``wanted`` are records with ``id``, ``key`` and ``title``; a page is looked
    up by its key in ``stored`` (pageId, title, score), or by its title if it
    has none (the first row of several with that title). Only what is not found, or has no score
    there, is handed to ``score_missing``, which extracts and scores its rows
    (id, score).
    """
    by_key = stored.where(F.col("pageId").isNotNull()).groupBy(F.col("pageId").alias(key)).agg(F.max("score").alias("score"), F.lit(True).alias("found"))
    by_title = stored.where(F.col("title").isNotNull()).groupBy("title").agg(F.min_by("score", "pageId").alias("score"), F.lit(True).alias("found"))
    keys = wanted.select("id", key, "title")
    looked_up = (keys.where(F.col(key).isNotNull()).join(by_key, key, "left").select("id", key, "score", "found")
                 .unionByName(keys.where(F.col(key).isNull()).join(by_title, "title", "left").select("id", key, "score", "found")))
    looked_up = materialize(looked_up.withColumn("found", F.coalesce("found", F.lit(False))))
    missing = wanted.join(looked_up.where(F.col("score").isNull()).select("id"), "id", "left_semi")
    scored = looked_up.join(score_missing(missing).select("id", F.col("score").alias("_new")), "id", "left")
    return scored.select("id", F.col(key).alias("pageId"), "found", F.coalesce("score", "_new").alias("score"))
