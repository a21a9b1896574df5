"""HTML → PageRecord pieces as regex column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions import patterns as P


def unescape(c: Column) -> Column:
    for ent, ch in P.HTML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, P.HTML_TAG, "")


def html_title(html: Column) -> Column:
    t = F.regexp_extract(html, P.HTML_TITLE, 1)
    return F.regexp_replace(unescape(strip_tags(t)), P.HTML_EDGE_WS, "")


def html_article(html: Column) -> Column:
    """The inner HTML of all ``<article>`` elements, else of the ``<body>``, else the whole page."""
    articles = F.array_join(F.regexp_extract_all(html, F.lit(P.HTML_ARTICLE), 1), "\n")
    body = F.when(F.regexp_like(html, F.lit(P.HTML_BODY)), F.regexp_extract(html, P.HTML_BODY, 1)).otherwise(html)
    return F.when(F.length(articles) > 0, articles).otherwise(body)


def html_text_from(src: Column) -> Column:
    """Article HTML → text in the page-object convention.

    Scripts, styles, comments and the ``<h1>`` title are dropped, ``<h2..h6>``
    written as ``\n\n== X ==\n`` section lines, block tags turned into line
    breaks, other tags removed and entities decoded.
    """
    x = F.regexp_replace(src, P.HTML_DROP, "")
    x = F.regexp_replace(x, P.HTML_HEADING, "\n\n== $1 ==\n")
    x = F.regexp_replace(x, P.HTML_BLOCK, "\n")
    x = unescape(strip_tags(x))
    return F.regexp_replace(x, P.HTML_EDGE_WS, "")


def html_text(html: Column) -> Column:
    """Article text of a whole page (see ``html_article`` / ``html_text_from``)."""
    return html_text_from(html_article(html))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, P.HREF_QUOTES, "")


def html_hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(P.HTML_HREF), 1), unquoted)


def internal_links(hrefs: Column) -> Column:
    return F.filter(hrefs, lambda h: h.startswith("/") & ~h.startswith("//"))


def external_links(hrefs: Column) -> Column:
    return F.filter(hrefs, lambda h: h.rlike("^https?://"))


def html_images(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(P.HTML_IMG), 1), unquoted)


def anchors(fragment: Column) -> Column:
    """array<struct<href, text>> of the ``<a href>`` elements in a fragment.

    Both arrays come from the same pattern, so they have equal length and
    align by position.
    """
    hrefs = F.transform(F.regexp_extract_all(fragment, F.lit(P.HTML_ANCHOR), 1), unquoted)
    texts = F.regexp_extract_all(fragment, F.lit(P.HTML_ANCHOR), 2)
    return F.arrays_zip(hrefs.alias("href"), texts.alias("text"))


def table_cells(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(P.HTML_CELL), 1)


def anchor_title(text: Column) -> Column:
    """Link text as a page title: tags stripped, entities decoded, quotes removed."""
    return F.replace(unescape(strip_tags(text)), F.lit('"'), F.lit(""))


def url_doc_key(url: Column) -> Column:
    return F.regexp_extract(url, P.URL_DOC_KEY, 1).try_cast("long")
