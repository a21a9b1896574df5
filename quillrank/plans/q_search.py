"""Registered queries: title search, first usable candidate, grid, suggestions, streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import grid as G
from quillrank.operators import search as SE
from quillrank.plans import learning as L
from quillrank.plans import oracle as O
from quillrank.plans.corpus import doc_feature_table, html_feature_table, labelled_doc_table, labelled_html_table, labels_table
from quillrank.plans.registry import r6, register, round_doubles
from quillrank.session import path_exists, scratch_path
from quillrank.sources import document_records, html_records, materialize
from quillrank.streaming import ingest as ING

_TOK = O.q(SE.TOKEN)

_SEARCH_SQL = f"""
d AS (SELECT id AS doc_id, length(title) AS tlen, regexp_extract_all(lower(title), {_TOK}) AS held FROM ({O.DOC_RECORDS})),
ph AS (SELECT id AS phrase_id, list_sort(list_distinct(regexp_extract_all(lower(title), {_TOK}))) AS wanted FROM ({O.HTML_RECORDS})),
hits AS (
  SELECT phrase_id, CAST(rank AS INTEGER) AS rank, doc_id FROM ph JOIN (
    SELECT wanted, doc_id, row_number() OVER (PARTITION BY wanted ORDER BY tlen, doc_id) AS rank
    FROM (SELECT DISTINCT wanted FROM ph WHERE len(wanted) > 0) JOIN d ON list_has_all(held, wanted)) USING (wanted)
  WHERE rank <= 3)"""


def _hits(spark, sf_dir):
    phrases = html_records(spark, sf_dir).select(F.col("id").alias("phrase_id"), F.col("title").alias("phrase"))
    titles = document_records(spark, sf_dir).select("id", "title")
    return SE.search_titles(phrases, titles)


@register("title_search_top3", sql=f"WITH {_SEARCH_SQL} SELECT phrase_id, rank, doc_id FROM hits")
def title_search_top3(spark, sf_dir):
    """Up to three stored titles that hold all words of each captured page's title."""
    return _hits(spark, sf_dir)


@register("first_scored_candidate", sql=f"""
WITH {O.doc_table()}, {_SEARCH_SQL},
j AS (SELECT h.phrase_id, h.rank, h.doc_id, t.score FROM hits h JOIN tbl t ON t.id = h.doc_id WHERE t.score IS NOT NULL)
SELECT phrase_id, rank, doc_id, {r6('score')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY rank) AS rn FROM j) WHERE rn = 1""")
def first_scored_candidate(spark, sf_dir):
    """Per phrase, the best-ranked hit that has a stored score."""
    scores = doc_feature_table(spark, sf_dir, ["pageId"]).select("id", "score")
    return round_doubles(SE.first_scored(_hits(spark, sf_dir), scores))


# -- grid --------------------------------------------------------------------------

def _standin_grid(spark):
    """Grid scored by a transparent stand-in (share of the intro-length axis)."""
    g = G.grid_points(spark)
    return G.grid_scores(g, F.col("n_words_summary") / F.lit(float(G.N_WORDS_SUMMARY_RANGE[1])))


@register("suggestions", sql=f"""
WITH {O.html_table()},
g AS (SELECT CAST(a * 5 AS DOUBLE) AS n_links, CAST(b * 5 AS DOUBLE) AS n_words_summary FROM range(100) t1(a), range(280) t2(b)),
q AS (SELECT * FROM g WHERE n_words_summary / 1400.0 > 0.9),
p AS (SELECT id, CAST(nLinks AS DOUBLE) AS x, CAST(nWordsSummary AS DOUBLE) AS y FROM htbl),
d AS (SELECT p.id, q.n_links, q.n_words_summary, sqrt(pow(p.x - q.n_links, 2) + pow(p.y - q.n_words_summary, 2)) AS distance FROM p, q)
SELECT id, CAST(rank AS INTEGER) AS rank, n_links, n_words_summary, {r6('distance')} AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, n_links, n_words_summary) AS rank FROM d) WHERE rank <= 5""")
def suggestions(spark, sf_dir):
    """Per captured page the 5 nearest grid points scoring > 0.9 (stand-in grid score)."""
    pages = html_feature_table(spark, sf_dir, ["nLinks", "nWordsSummary"]).select(
        "id", F.col("nLinks").alias("x"), F.col("nWordsSummary").alias("y"))
    return round_doubles(G.suggestions(pages, _standin_grid(spark)))


_GRID_FEATURES = ["nLinks", "nWordsSummary", "nSents", "meanWordLength", "grade_level"]


def _model_grid(spark, sf_dir):
    # Fit and medians only read labelled pages: the others are never measured.
    t = materialize(labelled_html_table(spark, sf_dir, _GRID_FEATURES + ["reading_ease"]))
    qm, _ = L.fit_models(t, _GRID_FEATURES, kinds=("rf",))
    # Q13: features off the grid axes are held at the featured medians (mergeable sketch).
    med = t.where("featured").agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5).alias(f)
                                    for f in _GRID_FEATURES[2:]]).first()
    g = G.grid_points(spark).select(F.col("n_links").alias("nLinks"), F.col("n_words_summary").alias("nWordsSummary"),
                                    *[F.lit(med[f]).cast("double").alias(f) for f in _GRID_FEATURES[2:]])
    scored = L.probability(qm.models["rf"], g)
    return t, scored.select(F.col("nLinks").alias("n_links"), F.col("nWordsSummary").alias("n_words_summary"),
                            F.col("p_high").alias("grid_score"))


@register("quality_grid")
def quality_grid(spark, sf_dir):
    """Forest probability over the 100 × 280 lattice (model fitted on labelled captures)."""
    return _model_grid(spark, sf_dir)[1]


@register("quality_grid_points", sql="SELECT CAST(a * 5 AS DOUBLE) AS n_links, CAST(b * 5 AS DOUBLE) AS n_words_summary, true AS in_range FROM range(100) t1(a), range(280) t2(b)")
def quality_grid_points(spark, sf_dir):
    """Every lattice point has a probability between 0 and 1."""
    return quality_grid(spark, sf_dir).select("n_links", "n_words_summary", F.col("grid_score").between(0, 1).alias("in_range"))


@register("grid_suggestions")
def grid_suggestions(spark, sf_dir):
    """M19 with the fitted model's grid: 5 nearest high-quality points per captured page."""
    _, grid = _model_grid(spark, sf_dir)
    grid = materialize(grid)
    pages = html_feature_table(spark, sf_dir, ["nLinks", "nWordsSummary"]).select(
        "id", F.col("nLinks").alias("x"), F.col("nWordsSummary").alias("y"))
    return G.suggestions(pages, grid)


# -- streaming ---------------------------------------------------------------------

_STREAM_RULE = ("CASE WHEN featured THEN 1.0::DOUBLE WHEN flagged THEN 0.0::DOUBLE WHEN "
                + " OR ".join(f"{c} IS NULL OR isnan(CAST({c} AS DOUBLE))" for c in ING.SCORE_FEATURES)
                + " THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, reading_ease / 100.0::DOUBLE)) END")
_DBL = {"meanSentLength", "meanWordLength", "grade_level", "reading_ease", "score"}


@register("incremental_ingest", sql=f"""
WITH {O.html_table()},
s AS (SELECT *, {_STREAM_RULE} AS score2 FROM htbl),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pageId ORDER BY id) AS rn FROM s) WHERE pageId IS NULL OR rn = 1)
SELECT {', '.join((r6('score2') + ' AS score') if c == 'score' else (r6(c) + f' AS {c}' if c in _DBL else c) for c in ING.SINK_COLUMNS)} FROM f""")
def incremental_ingest(spark, sf_dir):
    """Captured pages ingested by a Structured Streaming query (availableNow), sink read back."""
    sink = scratch_path(spark, "ingest_sink")
    ckpt = scratch_path(spark, "ingest_ckpt")
    q = ING.start_ingest(spark, sf_dir, "pages.parquet", labels_table(spark, sf_dir), sink, ckpt)
    q.awaitTermination()
    if not path_exists(spark, sink):
        return spark.createDataFrame([], html_feature_table(spark, sf_dir).select(*ING.SINK_COLUMNS).schema)
    return round_doubles(spark.read.parquet(sink).select(*ING.SINK_COLUMNS))


@register("incremental_ingest_scored")
def incremental_ingest_scored(spark, sf_dir):
    """T1 + M16: the streaming ingest scoring each micro-batch with the forest fitted on the corpus."""
    t = materialize(labelled_doc_table(spark, sf_dir, ING.SCORE_FEATURES + ["reading_ease"]))
    qm, _ = L.fit_models(t, ING.SCORE_FEATURES, kinds=("rf",))
    sink = scratch_path(spark, "ingest_scored_sink")
    q = ING.start_ingest(spark, sf_dir, "pages.parquet", labels_table(spark, sf_dir), sink,
                         scratch_path(spark, "ingest_scored_ckpt"), model=qm.models["rf"])
    q.awaitTermination()
    if not path_exists(spark, sink):
        return spark.createDataFrame([], html_feature_table(spark, sf_dir).select(*ING.SINK_COLUMNS).schema)
    return spark.read.parquet(sink).select(*ING.SINK_COLUMNS)


@register("incremental_ingest_rules", sql=f"""
WITH {O.html_table()},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pageId ORDER BY id) AS rn FROM htbl) WHERE pageId IS NULL OR rn = 1)
SELECT id, pageId, CASE WHEN featured THEN 1.0::DOUBLE WHEN flagged THEN 0.0::DOUBLE END AS fixed_score, true AS in_range FROM f""")
def incremental_ingest_rules(spark, sf_dir):
    """T1 + M16: of the stream scored by the forest, the rows, the scores that labels fix, and the range of the others."""
    rows = incremental_ingest_scored(spark, sf_dir)
    fixed = F.when(F.col("featured") | F.col("flagged"), F.col("score"))
    return rows.select("id", "pageId", fixed.alias("fixed_score"), F.coalesce(F.col("score").between(0, 1), F.lit(False)).alias("in_range"))


@register("grid_suggestions_checked", sql="SELECT page_id AS id, true AS checked FROM pages")
def grid_suggestions_checked(spark, sf_dir):
    """The suggestions of each captured page from the forest's grid are those of a plain search of all its good points."""
    _, grid = _model_grid(spark, sf_dir)
    grid = materialize(grid)
    pages = materialize(html_feature_table(spark, sf_dir, ["nLinks", "nWordsSummary"]).select(
        "id", F.col("nLinks").cast("double").alias("x"), F.col("nWordsSummary").cast("double").alias("y")))
    got = G.suggestions(pages, grid).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "n_links", "n_words_summary"))).alias("got"))
    # The plain search goes through all good points, once for each different position.
    want = G.plain_suggestions(pages.select("x", "y").distinct(), grid)
    empty = F.array().cast("array<struct<rank:int,n_links:double,n_words_summary:double>>")
    joined = (pages.join(want.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "want"), F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")), "left")
              .join(got, "id", "left"))
    return joined.select("id", (F.coalesce("got", empty) == F.coalesce("want", empty)).alias("checked"))
