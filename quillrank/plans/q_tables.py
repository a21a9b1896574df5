"""Registered queries: joins, lookups, de-duplication, rules, sinks (J, W1, P, C4, S4-S5, S10, E1-E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import html as H
from quillrank.functions import patterns as P
from quillrank.operators import links as LK
from quillrank.operators import tables as TB
from quillrank.operators.labels import DEFAULT_FLAG, FLAG_CODES, flag_dimension
from quillrank.plans import oracle as O
from quillrank.plans.corpus import doc_feature_table, html_feature_table, labels_table
from quillrank.plans.registry import r6, register, round_doubles
from quillrank.session import path_exists, scratch_path
from quillrank.sources import document_records, html_records, materialize, read_csv, read_table, spread, write_csv
from quillrank.sources.records import html_records_from
from quillrank.streaming.ingest import new_captures

# Score-rule inputs for the document corpus (nImages / nRefs are constant there).
RULE_FEATURES = ["nWordsSummary", "nSents", "meanSentLength", "meanWordLength", "grade_level"]

HTML_KEYS_SQL = f"SELECT page_id AS id, TRY_CAST(regexp_extract(url, {O.q(P.URL_DOC_KEY)}, 1) AS BIGINT) AS pageId FROM pages"


def html_keys(spark, sf_dir):
    """Captured pages as (id, pageId) — only the url column is read."""
    return read_table(spark, sf_dir, "pages", ["page_id", "url"]).select(
        F.col("page_id").alias("id"), H.url_doc_key(F.col("url")).alias("pageId"))


def first_captures(spark, sf_dir):
    """Records of the first capture of each article, found by url and id before any page is parsed."""
    return html_records_from(spread(new_captures(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), None)))


def doc_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id"]).select(F.col("doc_id").alias("page_id"))


def pages_html(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]).withColumnRenamed("page_id", "id")


# -- joins ---------------------------------------------------------------------

@register("new_pages", sql=f"""
SELECT doc_id AS page_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM ({HTML_KEYS_SQL}) h WHERE h.pageId = d.doc_id)""")
def new_pages(spark, sf_dir):
    """Documents not yet captured as a page (anti join on the article key)."""
    return TB.new_pages(doc_ids(spark, sf_dir), html_keys(spark, sf_dir))


@register("new_pages_by_title", sql=f"""
WITH c AS (SELECT d.id AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.id END AS page_id, d.title
           FROM ({O.DOC_RECORDS}) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.id),
h AS ({O.HTML_RECORDS})
SELECT doc_id, page_id, title FROM c
WHERE CASE WHEN page_id IS NOT NULL THEN page_id NOT IN (SELECT page_id FROM h WHERE page_id IS NOT NULL)
           ELSE title IS NULL OR title NOT IN (SELECT title FROM h WHERE title IS NOT NULL) END""")
def new_pages_by_title(spark, sf_dir):
    """Candidates looked up by id where they have one (labelled documents here), else by title."""
    docs = document_records(spark, sf_dir).select(F.col("id").alias("doc_id"), "title")
    labelled = labels_table(spark, sf_dir).select(F.col("doc_id").alias("page_id")).distinct()
    candidates = docs.join(labelled, docs["doc_id"] == labelled["page_id"], "left").select("doc_id", "page_id", "title")
    stored = html_records(spark, sf_dir).select(F.col("page_id").alias("pageId"), "title")
    return TB.new_pages(candidates, stored, title="title")


@register("existence_report", sql=f"""
WITH c AS (SELECT pageId AS k, count(*) AS n FROM ({HTML_KEYS_SQL}) WHERE pageId IS NOT NULL GROUP BY pageId)
SELECT doc_id AS page_id, CAST(coalesce(n, 0) AS BIGINT) AS n_copies, CAST(least(1, coalesce(n, 0)) AS INTEGER) AS in_table
FROM documents LEFT JOIN c ON doc_id = k""")
def existence_report(spark, sf_dir):
    """Every document id with its number of captures and a 0/1 presence flag."""
    return TB.existence_report(doc_ids(spark, sf_dir), html_keys(spark, sf_dir))


@register("existing_pages", sql=f"SELECT doc_id AS page_id FROM documents WHERE doc_id IN (SELECT pageId FROM ({HTML_KEYS_SQL}))")
def existing_pages(spark, sf_dir):
    """Only the document ids that are captured (semi join)."""
    return TB.existing_pages(doc_ids(spark, sf_dir), html_keys(spark, sf_dir))


_TCOLS = ", ".join(r6(c) + f" AS {c}" if c in ("meanWordLength", "meanSentLength", "reading_ease", "grade_level",
                                              "ColemanLiauIndex", "GunningFogIndex", "ARI", "SMOGIndex", "score")
                   else c for c in O.TABLE_COLUMNS)


@register("dedup_pages", sql=f"""
WITH {O.html_table()}
SELECT id, {_TCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY pageId ORDER BY id) AS rn FROM htbl)
WHERE pageId IS NULL OR rn = 1""")
def dedup_pages(spark, sf_dir):
    """Keep the first capture (smallest id) per article; null keys all stay."""
    return round_doubles(html_feature_table(spark, sf_dir, records=first_captures(spark, sf_dir)))


@register("remeasure_update", sql=f"""
WITH {O.doc_table()}, {O.html_table()},
r AS (SELECT pageId AS k, grade_level AS g, reading_ease AS e
      FROM (SELECT *, row_number() OVER (PARTITION BY pageId ORDER BY id) AS rn FROM htbl)
      WHERE rn = 1 AND pageId IS NOT NULL),
u AS (SELECT t.*, coalesce((t.featured OR t.flagged) AND r.k IS NOT NULL AND r.g IS NOT NULL, false) AS updated, r.g, r.e
      FROM tbl t LEFT JOIN r ON t.pageId = r.k)
SELECT id, pageId, featured, flagged, updated,
       {r6('CASE WHEN updated THEN g ELSE grade_level END')} AS grade_level,
       {r6('CASE WHEN updated THEN coalesce(e, reading_ease) ELSE reading_ease END')} AS reading_ease
FROM u""")
def remeasure_update(spark, sf_dir):
    """Labelled pages take grade/ease re-measured from their first capture."""
    stored = doc_feature_table(spark, sf_dir, ["pageId", "grade_level", "reading_ease"])
    again = html_feature_table(spark, sf_dir, ["pageId", "grade_level", "reading_ease"], records=first_captures(spark, sf_dir))
    out = TB.remeasure_update(stored, again.where(F.col("pageId").isNotNull()))
    return round_doubles(out.select("id", "pageId", "featured", "flagged", "updated", "grade_level", "reading_ease"))


@register("lookup_by_title", sql=f"""
WITH d AS (SELECT title AS t, min(id) AS doc_id, count(*) AS n_same_title FROM ({O.DOC_RECORDS}) GROUP BY title),
h AS ({O.HTML_RECORDS})
SELECT h.id AS capture_id, d.doc_id, h.title, d.n_same_title FROM h JOIN d ON d.t = h.title""")
def lookup_by_title(spark, sf_dir):
    """The first stored document (smallest id) whose title equals a captured page's title."""
    h = html_records(spark, sf_dir).select(F.col("id").alias("capture_id"), "title")
    out = TB.lookup_by_title(h, document_records(spark, sf_dir).select("id", "title"))
    return out.select("capture_id", "doc_id", "title", "n_same_title")


@register("lookup_by_id", sql=f"""
WITH {O.doc_table()}
SELECT h.id AS capture_id, t.pageId, t.nWordsSummary, {r6('t.grade_level')} AS grade_level, t.featured, t.flagged
FROM ({HTML_KEYS_SQL}) h JOIN tbl t ON t.pageId = h.pageId""")
def lookup_by_id(spark, sf_dir):
    """P5: stored features of the article behind each captured page (join on pageId)."""
    wanted = html_keys(spark, sf_dir).where("pageId IS NOT NULL").select(F.col("pageId").alias("_keep_id")).distinct()
    t = doc_feature_table(spark, sf_dir, ["pageId", "nWordsSummary", "grade_level"], only_ids=wanted)
    h = html_keys(spark, sf_dir).withColumnRenamed("id", "capture_id")
    return round_doubles(h.join(t, "pageId").select("capture_id", "pageId", "nWordsSummary", "grade_level", "featured", "flagged"))


def _rule_sql(score_expr: str) -> str:
    missing = " OR ".join(f"{c} IS NULL OR isnan(CAST({c} AS DOUBLE))" for c in RULE_FEATURES)
    return (f"CASE WHEN featured THEN 1.0::DOUBLE WHEN flagged THEN 0.0::DOUBLE WHEN {missing} THEN 0.0::DOUBLE "
            f"ELSE {score_expr} END")


_STANDIN_SQL = "CASE WHEN reading_ease IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, reading_ease / 100.0::DOUBLE)) END"


def _rule_col():
    return TB.score_rule(F.col("featured"), F.col("flagged"), [F.col(c) for c in RULE_FEATURES],
                         TB.standin_score(F.col("reading_ease")))


@register("score_rules", sql=f"WITH {O.doc_table()} SELECT id, featured, flagged, {r6(_rule_sql(_STANDIN_SQL))} AS score FROM tbl")
def score_rules(spark, sf_dir):
    """Rule order featured → flagged → missing feature → model (stand-in score here)."""
    t = doc_feature_table(spark, sf_dir, RULE_FEATURES + ["reading_ease"])
    return round_doubles(t.select("id", "featured", "flagged", _rule_col().alias("score")))


@register("fill_missing_scores", sql=f"WITH {O.doc_table()} SELECT id, {r6('coalesce(score, ' + _rule_sql(_STANDIN_SQL) + ')')} AS score FROM tbl")
def fill_missing_scores(spark, sf_dir):
    """P10: stored scores kept, null scores filled by the rule on demand."""
    t = doc_feature_table(spark, sf_dir, RULE_FEATURES + ["reading_ease"])
    return round_doubles(t.select("id", F.coalesce(F.col("score"), _rule_col()).alias("score")))


@register("score_writeback", sql=f"""
WITH {O.doc_table()}, s AS (SELECT pageId AS k, {_rule_sql(_STANDIN_SQL)} AS new_score FROM tbl WHERE NOT featured AND NOT flagged)
SELECT id, pageId, {r6('coalesce(s.new_score, tbl.score)')} AS score FROM tbl LEFT JOIN s ON tbl.pageId = s.k""")
def score_writeback(spark, sf_dir):
    """A separate score table written back onto the stored rows by pageId."""
    t = doc_feature_table(spark, sf_dir, ["pageId"] + RULE_FEATURES + ["reading_ease"])
    s = (t.where(~F.col("featured") & ~F.col("flagged"))
          .select(F.col("pageId").alias("_k"), _rule_col().alias("_new")))
    j = t.join(s, t["pageId"] == s["_k"], "left")
    return round_doubles(j.select("id", "pageId", F.coalesce(F.col("_new"), F.col("score")).alias("score")))


@register("rescore_candidates", sql=f"WITH {O.doc_table()} SELECT id, pageId FROM tbl WHERE NOT featured AND NOT flagged")
def rescore_candidates(spark, sf_dir):
    """Pages that are neither featured nor flagged (the fixed rescore guard)."""
    return TB.rescore_candidates(doc_feature_table(spark, sf_dir, ["pageId"])).select("id", "pageId")


@register("resume_from", sql=f"""
SELECT doc_id AS page_id FROM documents WHERE doc_id > (SELECT max(pageId) FROM ({HTML_KEYS_SQL}))""")
def resume_from(spark, sf_dir):
    """Work list after the watermark (largest article key already captured).

    The watermark is a scalar subquery: computed once, no join.
    """
    wm = html_keys(spark, sf_dir).agg(F.max("pageId"))
    return doc_ids(spark, sf_dir).where(F.col("page_id") > wm.scalar())


@register("label_counts", sql=f"""
WITH {O.doc_table()}
SELECT CASE WHEN featured THEN 'featured' WHEN flagged THEN 'flagged' ELSE 'unlabelled' END AS label, count(*) AS n
FROM tbl GROUP BY 1""")
def label_counts(spark, sf_dir):
    """A4: pages per label (featured wins over flagged)."""
    t = doc_feature_table(spark, sf_dir, ["pageId"])
    lab = F.when(F.col("featured"), "featured").when(F.col("flagged"), "flagged").otherwise("unlabelled")
    return t.groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_FLAG_VALUES = ", ".join(f"({O.q(n)}, {c})" for n, c in FLAG_CODES)


@register("flag_lookup", sql=f"""
SELECT l.doc_id, d.flag_name, d.flag_code
FROM (SELECT doc_id, {O.q(DEFAULT_FLAG)} AS flag_name FROM labels WHERE quality = 0) l
JOIN (VALUES {_FLAG_VALUES}) d(flag_name, flag_code) ON l.flag_name = d.flag_name""")
def flag_lookup(spark, sf_dir):
    """Flag category → code through the 10-row dimension (broadcast: fixed size)."""
    # The category comes from the label (a CASE on quality, not a literal), so
    # the lookup stays an equi-join instead of being folded into a filter plus
    # a cartesian product with the filtered dimension.
    name = F.when(F.col("quality") == 0, F.lit(DEFAULT_FLAG))
    flagged = labels_table(spark, sf_dir).select("doc_id", name.alias("flag_name")).where(F.col("flag_name").isNotNull())
    return flagged.join(F.broadcast(flag_dimension(spark)), "flag_name").select("doc_id", "flag_name", "flag_code")


# -- storage types and sinks ---------------------------------------------------

_STORAGE_SQL = ", ".join(
    f"TRY_CAST({c} AS {TB.STORAGE_DECIMALS[c].upper()}) AS {c}" if c in TB.STORAGE_DECIMALS
    else f"TRY_CAST({c} AS INTEGER) AS {c}" if c in TB.STORAGE_INTS
    else f"CAST({c} AS INTEGER) AS {c}" if c in ("flagged", "featured")
    else f"nullif({c}, 'NA') AS {c}" if c in ("title", "url")
    else c
    for c in O.TABLE_COLUMNS)


@register("storage_types", sql=f"WITH {O.doc_table()} SELECT id, {_STORAGE_SQL} FROM tbl")
def storage_types(spark, sf_dir):
    """C4: the stored view with DECIMAL/INT types; overflow becomes null."""
    return TB.to_storage_types(doc_feature_table(spark, sf_dir))


@register("feature_table_sink", sql=f"WITH {O.doc_table()} SELECT id, {_STORAGE_SQL} FROM tbl")
def feature_table_sink(spark, sf_dir):
    """Typed append of the feature table into a parquet table, read back."""
    path = scratch_path(spark, "feature_table")
    TB.to_storage_types(doc_feature_table(spark, sf_dir)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@register("csv_roundtrip", sql=f"WITH {O.doc_table()} SELECT id, {_TCOLS} FROM tbl")
def csv_roundtrip(spark, sf_dir):
    """Feature table written as CSV with a header and read back with its schema."""
    t = round_doubles(doc_feature_table(spark, sf_dir))
    path = scratch_path(spark, "features_csv")
    write_csv(t, path)
    return read_csv(spark, path, t.schema)


@register("csv_resume", sql=f"WITH {O.doc_table()} SELECT id, {_TCOLS} FROM tbl")
def csv_resume(spark, sf_dir):
    """S4 resume: read the CSV back, append only pages it does not hold yet (anti join on
    pageId), twice; the second pass finds everything stored and appends nothing."""
    t = materialize(round_doubles(doc_feature_table(spark, sf_dir)))
    path = scratch_path(spark, "features_csv_resume")
    for _ in range(2):
        todo = t
        if path_exists(spark, path):
            stored = read_csv(spark, path, t.schema)
            todo = TB.new_pages(t, stored, key="pageId", stored_key="pageId")
        write_csv(todo, path)
    return read_csv(spark, path, t.schema)


# -- links ---------------------------------------------------------------------

def _anchor_rows_sql(kind: str, hrefs: str, texts: str) -> str:
    title = f"replace({O._unescape(O._strip_tags('texts[i + 1]'))}, '\"', '')"
    return f"""SELECT id AS source_id, url AS source_url, '{kind}' AS list_kind, CAST(i AS BIGINT) AS position,
       hrefs[i + 1] AS href, {title} AS title
FROM (SELECT *, UNNEST(range(len(hrefs))) AS i FROM (
  SELECT page_id AS id, url, {hrefs} AS hrefs, {texts} AS texts,
         regexp_extract_all(html, {O.q(P.HTML_CELL)}, 1) AS cells FROM pages))"""


def _anchor_list(src: str, group: int) -> str:
    found = f"regexp_extract_all({src}, {O.q(P.HTML_ANCHOR)}, {group})"
    return O.unquoted(found) if group == 1 else found


PAGE_LINKS_SQL = _anchor_rows_sql("page", _anchor_list("html", 1), _anchor_list("html", 2))
_CELL5 = f"coalesce(regexp_extract_all(html, {O.q(P.HTML_CELL)}, 1)[5], '')"
FEATURED_LINKS_SQL = _anchor_rows_sql("featured", _anchor_list(_CELL5, 1), _anchor_list(_CELL5, 2))
_LAST3 = (f"list_slice(regexp_extract_all(html, {O.q(P.HTML_CELL)}, 1), "
          f"greatest(1, len(regexp_extract_all(html, {O.q(P.HTML_CELL)}, 1)) - 2), "
          f"greatest(1, len(regexp_extract_all(html, {O.q(P.HTML_CELL)}, 1)) - 2) + 2)")
FLAGGED_LINKS_SQL = _anchor_rows_sql(
    "flagged",
    f"flatten(list_transform({_LAST3}, lambda c: {_anchor_list('c', 1)}))",
    f"flatten(list_transform({_LAST3}, lambda c: {_anchor_list('c', 2)}))")


@register("page_links", sql=PAGE_LINKS_SQL)
def page_links(spark, sf_dir):
    """Every anchor of every captured page, with its position."""
    return LK.page_links(pages_html(spark, sf_dir))


@register("featured_links", sql=FEATURED_LINKS_SQL)
def featured_links(spark, sf_dir):
    """Anchors of the 5th table cell of each page."""
    return LK.featured_links(pages_html(spark, sf_dir))


@register("flagged_links", sql=FLAGGED_LINKS_SQL)
def flagged_links(spark, sf_dir):
    """Anchors of the last three table cells of each page."""
    return LK.flagged_links(pages_html(spark, sf_dir))


@register("links_union", sql=f"{FEATURED_LINKS_SQL} UNION ALL {FLAGGED_LINKS_SQL} UNION ALL {PAGE_LINKS_SQL}")
def links_union(spark, sf_dir):
    """Bag union of the three link lists."""
    return LK.all_links(pages_html(spark, sf_dir))


@register("link_table", sql=PAGE_LINKS_SQL)
def link_table(spark, sf_dir):
    """The collected link list persisted as parquet and read back."""
    path = scratch_path(spark, "links")
    LK.page_links(pages_html(spark, sf_dir)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
