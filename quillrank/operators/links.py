"""Link lists from list pages and captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import html as H

LINK_COLUMNS = ["source_id", "source_url", "list_kind", "position", "href", "title"]


def _featured(html) -> "F.Column":
    return H.anchors(F.coalesce(F.get(H.table_cells(html), 4), F.lit("")))


def _flagged(html) -> "F.Column":
    cells = H.table_cells(html)
    last3 = F.slice(cells, F.greatest(F.lit(1), F.size(cells) - 2), 3)
    return F.flatten(F.transform(last3, lambda c: H.anchors(c)))


#: The link lists of a page, by kind.
KINDS = {"featured": _featured, "flagged": _flagged, "page": H.anchors}


def _links(pages: DataFrame, kinds: list[str]) -> DataFrame:
    """The lists of the given kinds from one scan of the pages."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), KINDS[k](F.col("html")).alias("anchors")) for k in kinds])
    each = pages.select("id", "url", F.explode(lists).alias("l")).select("id", "url", "l.kind", F.posexplode("l.anchors").alias("position", "a"))
    return each.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), F.col("kind").alias("list_kind"),
                       F.col("position").cast("long").alias("position"), F.col("a.href").alias("href"),
                       H.anchor_title(F.col("a.text")).alias("title"))


def featured_links(pages: DataFrame) -> DataFrame:
    """Anchors of the 5th table cell (index 4) of each list page; none if absent."""
    return _links(pages, ["featured"])


def flagged_links(pages: DataFrame) -> DataFrame:
    """Anchors of the last three table cells, in cell then anchor order."""
    return _links(pages, ["flagged"])


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor of a page as (position, href, title)."""
    return _links(pages, ["page"])


def all_links(pages: DataFrame) -> DataFrame:
    """E5: the bag union of the three lists, from one scan."""
    return _links(pages, list(KINDS))


def links_union(*lists: DataFrame) -> DataFrame:
    """Bag union of link lists (no de-duplication, no shuffle)."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out
