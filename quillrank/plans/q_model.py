"""Registered queries: buckets, split, standardisation, models and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import buckets as BK
from quillrank.operators.split import add_split, split_sql, standardize
from quillrank.operators.tables import standin_score
from quillrank.plans import learning as L
from quillrank.plans import oracle as O
from quillrank.plans.corpus import doc_feature_table, html_feature_table, labelled_doc_table
from quillrank.functions import html as H
from quillrank.operators import search as SE
from quillrank.plans.q_tables import HTML_KEYS_SQL, RULE_FEATURES
from quillrank.plans.registry import r6, register, round_doubles
from quillrank.session import scratch_path
from quillrank.sources import materialize, read_table, spread
from quillrank.sources.records import html_records_from

# Model inputs on the document corpus: nImages / nRefs / nLinks are constant
# there, so the learning queries use these (grade_level stays unbucketed).
MODEL_FEATURES = RULE_FEATURES
BUCKETED = [f for f in MODEL_FEATURES if f != "grade_level"]
TABLE_NEEDS = MODEL_FEATURES + ["reading_ease"]
#: What ``learning.usable_rows`` looks at.
USABLE_NEEDS = ["meanWordLength", "reading_ease"]


def _table(spark, sf_dir):
    """The model inputs for every page, computed once and checkpointed."""
    return materialize(doc_feature_table(spark, sf_dir, TABLE_NEEDS))


def _labelled(spark, sf_dir, reread: bool = False, needs: list[str] | None = None):
    """The model inputs (or what is needed of them) of labelled pages only; unlabelled pages are never measured.

    Stored for what reads them more than once or keeps only rows with certain
    measures: such a filter moves below the measures, and each is worked out
    again wherever its condition names it.
    """
    rows = labelled_doc_table(spark, sf_dir, needs or TABLE_NEEDS)
    return materialize(rows) if reread else rows


def _feat_avg(f):
    return f"avg(CASE WHEN featured THEN CAST({f} AS DOUBLE) END)"


def _feat_std(f):
    return f"stddev_pop(CASE WHEN featured THEN CAST({f} AS DOUBLE) END)"


_MAXIMA_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {_feat_avg(f)} AS mean, {_feat_std(f)} AS std, {_feat_avg(f)} + {_feat_std(f)} AS mx FROM tbl"
    for f in BUCKETED)


@register("bucket_maxima", sql=f"WITH {O.doc_table()} SELECT feature, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mx')} AS max FROM ({_MAXIMA_SQL})")
def bucket_maxima(spark, sf_dir):
    """A2/M1: avg + population std of each bucketed feature over featured pages (one aggregate)."""
    return round_doubles(BK.maxima_frame(_labelled(spark, sf_dir), BUCKETED))


@register("bucket_edges", sql=f"""
WITH {O.doc_table()}
SELECT feature, CAST(i AS INTEGER) AS edge_index, {r6('i * (mx / 99.0)')} AS edge
FROM (SELECT feature, mx, UNNEST(range(99)) AS i FROM ({_MAXIMA_SQL}))""")
def bucket_edges(spark, sf_dir):
    """M2: the 99 left edges per bucketed feature."""
    return round_doubles(BK.edges_frame(BK.maxima_frame(_labelled(spark, sf_dir), BUCKETED)))


def _bucket_sql_oracle(f):
    x = f"CAST({f} AS DOUBLE)"
    return (f"CAST(CASE WHEN {f} IS NULL OR isnan({x}) THEN 99 ELSE coalesce(list_position("
            f"list_transform(range(1, 99), lambda i: {x} < i * (m_{f} / 99.0)), true) - 1, 99) END AS INTEGER)")


_MX_ROW = ", ".join(f"{_feat_avg(f)} + {_feat_std(f)} AS m_{f}" for f in BUCKETED)


@register("bucketize", sql=f"""
WITH {O.doc_table()}, mx AS (SELECT {_MX_ROW} FROM tbl)
SELECT id, {', '.join(_bucket_sql_oracle(f) + f' AS {f}' for f in BUCKETED)} FROM tbl, mx""")
def bucketize(spark, sf_dir):
    """M3: every page's bucket per feature against the fitted maxima."""
    t = _table(spark, sf_dir)
    maxima = BK.collect_maxima(t, BUCKETED)
    return BK.bucketize(t.select("id", *BUCKETED), maxima)


_USABLE = ("(featured OR flagged) AND meanWordLength IS NOT NULL AND NOT isnan(meanWordLength) "
           "AND reading_ease IS NOT NULL AND NOT isnan(reading_ease)")


@register("training_rows", sql=f"""
WITH {O.doc_table()}
SELECT id, pageId, featured, flagged, {', '.join(r6(f) + ' AS ' + f if f in ('meanSentLength', 'meanWordLength', 'grade_level') else f for f in MODEL_FEATURES)}
FROM tbl WHERE {_USABLE}""")
def training_rows(spark, sf_dir):
    """Labelled rows with meanWordLength and reading_ease present."""
    return round_doubles(L.usable_rows(_labelled(spark, sf_dir, reread=True)).select("id", "pageId", "featured", "flagged", *MODEL_FEATURES))


@register("train_test_split", sql=f"""
WITH {O.doc_table()}
SELECT id, pageId, CASE WHEN featured THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, {split_sql('pageId')} < 6 AS is_train
FROM tbl WHERE {_USABLE}""")
def train_test_split(spark, sf_dir):
    """M4: reproducible 60/40 hash split of the usable labelled rows."""
    t = L.with_label(add_split(L.usable_rows(_labelled(spark, sf_dir, reread=True, needs=USABLE_NEEDS)), "pageId", L.TEST_SHARE, 0))
    return t.select("id", "pageId", "label", "is_train")


def _z_sql(f):
    return (f"CASE WHEN s_{f} > 0 THEN (CAST({f} AS DOUBLE) - m_{f}) / s_{f} ELSE 0.0::DOUBLE END")


@register("standardize", sql=f"""
WITH {O.doc_table()},
u AS (SELECT *, {split_sql('pageId')} < 6 AS is_train FROM tbl WHERE {_USABLE}),
st AS (SELECT {', '.join(f'avg(CAST({f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}' for f in MODEL_FEATURES)} FROM u WHERE is_train)
SELECT id, {', '.join(r6(_z_sql(f)) + f' AS {f}_z' for f in MODEL_FEATURES)} FROM u, st""")
def standardize_query(spark, sf_dir):
    """M5: z-scores with mean and population std of the training part."""
    u = add_split(L.usable_rows(_labelled(spark, sf_dir, reread=True)), "pageId", L.TEST_SHARE, 0)
    z = standardize(u, MODEL_FEATURES, where=F.col("is_train"))
    return round_doubles(z.select("id", *[f"{f}_z" for f in MODEL_FEATURES]))


@register("confusion_metrics", sql=f"""
WITH {O.doc_table()},
p AS (SELECT CASE WHEN {split_sql('pageId')} < 6 THEN 'train' ELSE 'test' END AS split,
             CASE WHEN featured THEN 1.0 ELSE 0.0 END AS label,
             CASE WHEN greatest(0.0, least(1.0, reading_ease / 100.0)) > 0.5 THEN 1.0 ELSE 0.0 END AS prediction
      FROM tbl WHERE {_USABLE}),
g AS (SELECT split, count(*) AS n, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS ok,
             CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM p GROUP BY split)
SELECT split, n, tp, fp, fn, {r6('ok / n')} AS accuracy,
       {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END')} AS recall,
       {r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END')} AS precision FROM g""")
def confusion_metrics(spark, sf_dir):
    """A5: accuracy / recall / precision per split for a deterministic threshold rule."""
    u = L.with_label(add_split(L.usable_rows(_labelled(spark, sf_dir, reread=True, needs=USABLE_NEEDS)), "pageId", L.TEST_SHARE, 0))
    p = u.select(F.when(F.col("is_train"), "train").otherwise("test").alias("split"), "label",
                 F.when(standin_score(F.col("reading_ease")) > 0.5, 1.0).otherwise(0.0).alias("prediction"))
    return round_doubles(L.confusion_metrics(p, ["split"]))


# -- fitted models (rows-only checks; invariants in tests) -----------------------

def _fit(spark, sf_dir, kinds, labelled_only=False):
    t = _labelled(spark, sf_dir, reread=True) if labelled_only else _table(spark, sf_dir)
    qm, labelled = L.fit_models(t, MODEL_FEATURES, kinds=kinds)
    return t, qm, labelled


def _scores(kind):
    def q(spark, sf_dir):
        t, qm, _ = _fit(spark, sf_dir, (kind,))
        s = L.score_table(qm.models[kind], t, MODEL_FEATURES)
        return s.select("id", "pageId", "p_high", "score", L.display_score(F.col("score")).alias("display_score"))
    q.__name__ = f"{kind}_scores"
    q.__doc__ = f"{kind} pipeline fitted on the labelled pages; P(high quality), rule score and 1..10 score for every page."
    return q


register("rf_scores")(_scores("rf"))          # M6, M11
register("logreg_scores")(_scores("logreg"))  # M7
register("xtrees_scores")(_scores("xtrees"))  # M8


@register("model_report")
def model_report(spark, sf_dir):
    """Three models fitted on one training frame, metrics per split."""
    _, qm, labelled = _fit(spark, sf_dir, L.MODEL_KINDS, labelled_only=True)
    return L.model_report(qm, labelled)


@register("feature_importances")
def feature_importances(spark, sf_dir):
    """Forest feature importances by feature name."""
    _, qm, _ = _fit(spark, sf_dir, ("rf",), labelled_only=True)
    return L.feature_importances(qm, "rf")


@register("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Save the fitted pipeline to the shared folder, load it back, score with both."""
    t, qm, _ = _fit(spark, sf_dir, ("rf",))
    path = scratch_path(spark, "rf_model")
    L.save_model(qm.models["rf"], path)
    loaded = L.load_model(path)
    a = L.probability(qm.models["rf"], t).select("id", F.col("p_high").alias("p_fitted"))
    b = L.probability(loaded, t).select("id", F.col("p_high").alias("p_loaded"))
    return a.join(b, "id").withColumn("same", F.col("p_fitted") == F.col("p_loaded"))


@register("rescore_all")
def rescore_all(spark, sf_dir):
    """The whole stored table re-scored (rule + forest) in one pass."""
    t, qm, _ = _fit(spark, sf_dir, ("rf",))
    return L.score_table(qm.models["rf"], t, MODEL_FEATURES).select("id", "pageId", "featured", "flagged", "score")


@register("score_new_pages")
def score_new_pages(spark, sf_dir):
    """Captured pages looked up among the stored (labelled) ones; only the others are extracted and scored by the model."""
    labelled, qm, _ = _fit(spark, sf_dir, ("rf",), labelled_only=True)
    # The key is enough here: every capture has one, and the title column would make the look-up parse pages.
    stored = L.score_table(qm.models["rf"], labelled, MODEL_FEATURES).select("pageId", F.lit(None).cast("string").alias("title"), "score")
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]).select(
        F.col("page_id").alias("id"), H.url_doc_key(F.col("url")).alias("article"), F.lit(None).cast("string").alias("title"), "page_id", "url", "html")

    def score(missing):
        records = html_records_from(spread(missing.select("page_id", "url", "html")))
        return L.score_table(qm.models["rf"], html_feature_table(spark, sf_dir, TABLE_NEEDS, records=records), MODEL_FEATURES)

    s = SE.lookup_or_score(pages, stored, score, key="article")
    return s.select("id", "pageId", "found", "score", L.display_score(F.col("score")).alias("display_score"))


# -- checked companions of the model queries ---------------------------------------

@register("stored_model_scores", sql="SELECT model, doc_id AS id, true AS same FROM documents, (VALUES ('rf'), ('logreg'), ('xtrees')) m(model)")
def stored_model_scores(spark, sf_dir):
    """Each fitted model's scores equal those worked out from what its saved form holds (nodes, coefficients)."""
    t, qm, _ = _fit(spark, sf_dir, L.MODEL_KINDS)
    out = []
    for kind, model in qm.models.items():
        path = scratch_path(spark, f"{kind}_model")
        L.save_model(model, path)
        fitted = L.probability(model, t).select("id", "p_high")
        both = fitted.join(L.stored_scores(spark, path, t), "id", "left")
        # A page without a text has features that are no numbers, and so no logistic score.
        same = F.col("p_high").eqNullSafe(F.col("p_stored")) | F.coalesce(F.abs(F.col("p_high") - F.col("p_stored")) < 1e-9, F.lit(False))
        out.append(both.select(F.lit(kind).alias("model"), "id", same.alias("same")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("model_report_counts", sql=f"""
WITH {O.doc_table()},
u AS (SELECT CASE WHEN {split_sql('pageId')} < 6 THEN 'train' ELSE 'test' END AS split, featured FROM tbl WHERE {_USABLE})
SELECT model, split, count(*) AS n, count(*) FILTER (WHERE featured) AS n_featured, true AS consistent
FROM u, (VALUES ('rf'), ('logreg'), ('xtrees')) m(model) GROUP BY model, split""")
def model_report_counts(spark, sf_dir):
    """The report's counts per model and part, and that its measures follow from them."""
    r = model_report(spark, sf_dir)
    hits = F.col("accuracy") * F.col("n")
    agree = (F.abs(hits - (F.col("n") - F.col("fp") - F.col("fn"))) < 1e-6) & (F.coalesce(F.abs(F.col("recall") * (F.col("tp") + F.col("fn")) - F.col("tp")) < 1e-6, F.col("tp") + F.col("fn") == 0)) \
        & F.coalesce(F.abs(F.col("precision") * (F.col("tp") + F.col("fp")) - F.col("tp")) < 1e-6, F.col("tp") + F.col("fp") == 0)
    return r.select("model", "split", "n", (F.col("tp") + F.col("fn")).alias("n_featured"), agree.alias("consistent"))


@register("model_roundtrip_same", sql="SELECT doc_id AS id, true AS same FROM documents")
def model_roundtrip_same(spark, sf_dir):
    """A saved and loaded model scores every page as the fitted one."""
    return model_roundtrip(spark, sf_dir).select("id", "same")


@register("score_new_pages_lookup", sql=f"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM labels WHERE quality IN (0, 1) GROUP BY doc_id)
SELECT id, pageId, l.doc_id IS NOT NULL AS found, l.score AS stored_score, true AS in_range FROM ({HTML_KEYS_SQL}) LEFT JOIN l ON l.doc_id = pageId""")
def score_new_pages_lookup(spark, sf_dir):
    """Which captures were found, with their stored scores; every capture has a score between 0 and 1."""
    s = score_new_pages(spark, sf_dir)
    return s.select("id", "pageId", "found", F.when(F.col("found"), F.col("score")).alias("stored_score"), F.coalesce(F.col("score").between(0, 1), F.lit(False)).alias("in_range"))


@register("rescore_all_labelled", sql="SELECT doc_id AS id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM labels JOIN documents USING (doc_id)")
def rescore_all_labelled(spark, sf_dir):
    """The scores that the label rule fixes."""
    return rescore_all(spark, sf_dir).where("featured OR flagged").select("id", "score")


@register("rescore_all_in_range", sql="SELECT doc_id AS id, true AS in_range FROM documents")
def rescore_all_in_range(spark, sf_dir):
    """Every page has a score between 0 and 1."""
    return rescore_all(spark, sf_dir).select("id", F.coalesce(F.col("score").between(0, 1), F.lit(False)).alias("in_range"))


@register("feature_importances_sum", sql="SELECT UNNEST([" + ", ".join(f"'{f}'" for f in MODEL_FEATURES) + "]) AS feature, true AS sums_to_one")
def feature_importances_sum(spark, sf_dir):
    """An importance for each feature, one in total."""
    found = feature_importances(spark, sf_dir)
    total = found.agg(F.abs(F.sum("importance") - 1) < 1e-6).first()[0]
    return found.select("feature", F.lit(bool(total)).alias("sums_to_one"))
