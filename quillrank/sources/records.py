"""Input adapters: driver tables → PageRecord.

PageRecord = id, page_id, revision_id, url, title, content, summary,
links, images, references. ``id`` is the storage row key (ordering key for
de-duplication); ``page_id`` the article key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import html as H
from quillrank.functions import patterns as P
from quillrank.sources.tables import read_table, spread

RECORD_COLUMNS = ["id", "page_id", "revision_id", "url", "title", "content", "summary", "links", "images", "references"]


def _empty():
    return F.array().cast("array<string>")


def first_line(c):
    return F.substring_index(c, "\n", 1)


def introduction(c):
    """The text before the first section heading; all of it if there is none."""
    return F.when(c.startswith("=="), F.lit("")).otherwise(F.substring_index(c, P.SECTION_SEP, 1))


def document_records(spark: SparkSession, sf_dir: str, only_ids: DataFrame | None = None) -> DataFrame:
    """``documents`` → PageRecord.

    page_id = doc_id; content = text; summary = the introduction; title = the
    whole first line; url = ``/{lang}/{doc_id}``; documents carry no links,
    images or references.
    ``only_ids`` (a frame with column ``_keep_id``) restricts the scan first.
    """
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    if only_ids is not None:
        # Keep only the wanted documents before spreading and measuring them.
        d = d.join(only_ids, d["doc_id"] == only_ids["_keep_id"], "left_semi")
    d = spread(d)
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("page_id"),
        F.lit(None).cast("long").alias("revision_id"),
        F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        first_line(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        introduction(F.col("text")).alias("summary"),
        _empty().alias("links"),
        _empty().alias("images"),
        _empty().alias("references"),
    )


def html_records(spark: SparkSession, sf_dir: str, only_ids: DataFrame | None = None) -> DataFrame:
    """``pages`` → PageRecord (E6), all regex work on the JVM.

    id and revision_id = the capture's page_id; page_id = the article key in
    the url (several captures may share it); links = site-internal hrefs,
    references = http(s) hrefs, images = ``<img src>``. ``only_ids`` (column
    ``_keep_id``) restricts the scan to those article keys first.
    """
    p = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    if only_ids is not None:
        # Keep only captures of the wanted articles before spreading and measuring.
        p = p.join(only_ids, H.url_doc_key(p["url"]) == only_ids["_keep_id"], "left_semi")
    p = spread(p)
    return html_records_from(p)


def html_records_from(p: DataFrame) -> DataFrame:
    # hrefs and the article element each feed two outputs: extract them once
    # in their own projection.
    staged = p.select("page_id", "url", "html", H.html_hrefs(F.col("html")).alias("_hrefs"),
                      H.html_article(F.col("html")).alias("_src"))
    return (
        staged.select(
            F.col("page_id").alias("id"),
            H.url_doc_key(F.col("url")).alias("page_id"),
            F.col("page_id").alias("revision_id"),
            F.col("url"),
            H.html_title(F.col("html")).alias("title"),
            H.html_text_from(F.col("_src")).alias("content"),
            H.internal_links(F.col("_hrefs")).alias("links"),
            H.external_links(F.col("_hrefs")).alias("references"),
            H.html_images(F.col("html")).alias("images"),
        )
        .withColumn("summary", introduction(F.col("content")))
        .select(*RECORD_COLUMNS)
    )
