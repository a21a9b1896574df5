"""Registered queries: aggregates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import reports as RP
from quillrank.operators.tables import score_rule, standin_score
from quillrank.plans import oracle as O
from quillrank.plans.corpus import doc_feature_table
from quillrank.plans.q_tables import _STANDIN_SQL, RULE_FEATURES, _rule_sql
from quillrank.plans.registry import ORACLE, r6, register, round_doubles
from quillrank.session import scratch_path
from quillrank.sources import materialize


def _means_sql() -> str:
    parts = []
    for feat, cond in RP.MEAN_FEATURES:
        c = f"{feat} < {cond}" if cond is not None else "true"
        parts.append(f"""SELECT '{feat}' AS feature,
  {r6(f"avg(CASE WHEN {c} THEN CAST({feat} AS DOUBLE) END)")} AS all_mean,
  {r6(f"avg(CASE WHEN featured AND {c} THEN CAST({feat} AS DOUBLE) END)")} AS featured_mean,
  {r6(f"avg(CASE WHEN flagged AND {c} THEN CAST({feat} AS DOUBLE) END)")} AS flagged_mean FROM tbl""")
    return f"WITH {O.doc_table()} " + " UNION ALL ".join(parts)


@register("feature_means", sql=_means_sql())
def feature_means(spark, sf_dir):
    """Population means (all, featured, flagged) of the report features, one scan."""
    return round_doubles(RP.feature_means(doc_feature_table(spark, sf_dir)))


# -- page and averages reports (L1-L7, S9) --------------------------------------


_REPORT_NEEDS = ["grade_level", "nLinks", "nRefs", "nWordsSummary", "nImages", "reading_ease", "title", "url"] + RULE_FEATURES


def _report_table(spark, sf_dir, reread: bool = False):
    """The scored pages; stored only for reports that read them more than once."""
    t = doc_feature_table(spark, sf_dir, sorted(set(_REPORT_NEEDS)))
    rule = score_rule(F.col("featured"), F.col("flagged"), [F.col(c) for c in RULE_FEATURES],
                      standin_score(F.col("reading_ease")))
    scored = t.withColumn("score", F.coalesce(F.col("score"), rule))
    return materialize(scored) if reread else scored


_SCORE_SQL = f"coalesce(score, {_rule_sql(_STANDIN_SQL)})"


def _unpivot_sql(extra: str = "") -> str:
    parts = [f"SELECT id, '{f}' AS feature, '{lab}' AS label_name, {lo!r}::DOUBLE AS xmin, {hi!r}::DOUBLE AS xmax, "
             f"CAST({f} AS DOUBLE) AS value{extra} FROM st" for f, lab, lo, hi in RP.REPORT_FEATURES]
    return " UNION ALL ".join(parts)


_ST = f"st AS (SELECT *, {_SCORE_SQL} AS s FROM tbl)"
_FRAC = "CASE WHEN value IS NULL OR isnan(value) THEN 0.0::DOUBLE ELSE (greatest(least(value, xmax), xmin) - xmin) / (xmax - xmin) END"


def _mean_sql(which: str) -> str:
    cond = {"all": "true", "featured": "featured", "flagged": "flagged"}[which]
    cases = " ".join(
        f"WHEN feature = '{f}' THEN (SELECT avg(CASE WHEN {cond} {'AND grade_level < 20' if f == 'grade_level' else ''} "
        f"THEN CAST({f} AS DOUBLE) END) FROM tbl)"
        for f, _, _, _ in RP.REPORT_FEATURES)
    return f"CASE {cases} END"


@register("display_score", sql=f"WITH {O.doc_table()}, {_ST} SELECT id, {r6('s')} AS score, CAST(round(9.0 * s + 1.0) AS INTEGER) AS display_score FROM st")
def display_score(spark, sf_dir):
    """L1: stored or rule score (stand-in model) shown on the 1..10 scale."""
    t = _report_table(spark, sf_dir)
    return round_doubles(t.select("id", "score", RP.display_score(F.col("score")).alias("display_score")))


@register("bar_fractions", sql=f"WITH {O.doc_table()}, {_ST} SELECT id, feature, {r6('value')} AS value, {r6(_FRAC)} AS frac FROM ({_unpivot_sql()})")
def bar_fractions(spark, sf_dir):
    """Each page's clamped 0..1 position on every report bar."""
    b = RP.bar_fractions(_report_table(spark, sf_dir), ["id"])
    return round_doubles(b.select("id", "feature", "value", "frac"))


@register("mean_fractions", sql=f"""
WITH {O.doc_table()}
SELECT feature, label_name, {r6("(m_all - xmin) / (xmax - xmin)")} AS all_frac,
       {r6("(m_featured - xmin) / (xmax - xmin)")} AS featured_frac, {r6("(m_flagged - xmin) / (xmax - xmin)")} AS flagged_frac
FROM (SELECT feature, label_name, xmin, xmax, {_mean_sql('all')} AS m_all, {_mean_sql('featured')} AS m_featured,
             {_mean_sql('flagged')} AS m_flagged
      FROM (VALUES {', '.join(f"('{f}', '{lab}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for f, lab, lo, hi in RP.REPORT_FEATURES)})
           v(feature, label_name, xmin, xmax))""")
def mean_fractions(spark, sf_dir):
    """L3: population means on the 0..1 bar scale, unclamped."""
    return round_doubles(RP.mean_fractions(_report_table(spark, sf_dir)))


@register("bar_labels", sql=f"""
WITH {O.doc_table()}, {_ST}
SELECT id, feature, label_name || ' = ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS label FROM ({_unpivot_sql()})""")
def bar_labels(spark, sf_dir):
    """L4: '<feature label> = <rounded value>' per page and feature."""
    b = RP.bar_fractions(_report_table(spark, sf_dir), ["id"])
    return b.select("id", "feature", RP.bar_label(F.col("label_name"), F.col("value")).alias("label"))


_PAGE_SQL = f"""
WITH {O.doc_table()}, {_ST}, u AS ({_unpivot_sql(", CAST(round(9.0 * s + 1.0) AS INTEGER) AS display_score")})
SELECT id, feature, label_name || ' = ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS label, {r6('value')} AS value,
       {r6(_FRAC)} AS frac, {r6('0.0 + (' + _FRAC + ') * 350.0')} AS x_page,
       {r6("0.0 + (" + _mean_sql('featured') + " - xmin) / (xmax - xmin) * 350.0")} AS x_featured_mean, display_score
FROM u"""


@register("page_report", sql=_PAGE_SQL)
def page_report(spark, sf_dir):
    """L5-L7 (page mode): label, bar end, featured-mean marker, display score per page."""
    t = _report_table(spark, sf_dir, reread=True)
    r = RP.page_report(t.withColumn("display_score", RP.display_score(F.col("score"))), ["id", "display_score"])
    return round_doubles(r.select("id", "feature", "label", "value", "frac", "x_page", "x_featured_mean", "display_score"))


@register("bar_geometry", sql=f"WITH q AS ({_PAGE_SQL}) SELECT id, feature, x_page, x_featured_mean FROM q")
def bar_geometry(spark, sf_dir):
    """Bar coordinates on the 0..350 axis (page mode shows the featured mean only)."""
    t = _report_table(spark, sf_dir, reread=True)
    return round_doubles(RP.page_report(t, ["id"]).select("id", "feature", "x_page", "x_featured_mean"))


@register("analytics_report", sql=f"""
WITH {O.doc_table()}, m AS (
SELECT feature, label_name, xmin, xmax, {_mean_sql('all')} AS m_all, {_mean_sql('featured')} AS m_featured,
       {_mean_sql('flagged')} AS m_flagged
FROM (VALUES {', '.join(f"('{f}', '{lab}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for f, lab, lo, hi in RP.REPORT_FEATURES)})
     v(feature, label_name, xmin, xmax))
SELECT feature, label_name AS label, 0.0::DOUBLE AS x_page,
       {r6("0.0 + (m_all - xmin) / (xmax - xmin) * 350.0")} AS x_all_mean,
       {r6("0.0 + (m_featured - xmin) / (xmax - xmin) * 350.0")} AS x_featured_mean,
       {r6("0.0 + (m_flagged - xmin) / (xmax - xmin) * 350.0")} AS x_flagged_mean,
       {r6("0.0 + (m_featured - xmin) / (xmax - xmin) * 350.0 + 4.0")} AS x_featured_mean_end
FROM m""")
def analytics_report(spark, sf_dir):
    """L6/L7 (averages mode): all three population means as markers per feature."""
    return round_doubles(RP.analytics_report(_report_table(spark, sf_dir)))


def _json_sql():
    items = ", ".join(f"{{'label': '{f}', 'value': CAST(round({f}) AS BIGINT)}}" for f, _, _, _ in RP.REPORT_FEATURES)
    return f"""WITH {O.doc_table()}, {_ST}
SELECT id, CAST(to_json({{'results': [[{items}]], 'searchPhrase': title, 'url': url,
                          'quality_score': CAST(round(9.0 * s + 1.0) AS INTEGER)}}) AS VARCHAR) AS json FROM st"""


@register("score_json", sql=_json_sql())
def score_json(spark, sf_dir):
    """The JSON result document per page ({results, searchPhrase, url, quality_score})."""
    t = _report_table(spark, sf_dir)
    items = F.array(*[F.struct(F.lit(f).alias("label"), F.round(F.col(f), 0).cast("long").alias("value"))
                      for f, _, _, _ in RP.REPORT_FEATURES])
    doc = F.struct(F.array(items).alias("results"), F.col("title").alias("searchPhrase"), F.col("url").alias("url"),
                   RP.display_score(F.col("score")).alias("quality_score"))
    return t.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))




@register("averages_report_sink", sql=ORACLE["analytics_report"])
def averages_report_sink(spark, sf_dir):
    """The averages report persisted as JSON lines (overwrite) and read back."""
    r = RP.analytics_report(_report_table(spark, sf_dir))
    r = round_doubles(r)
    path = scratch_path(spark, "averages_report")
    r.coalesce(1).write.mode("overwrite").json(path)  # 5 rows: one file is right here
    return spark.read.schema(r.schema).json(path)
