"""Plan-shape checks: pruning, pushdown, partial aggregation, pre-shuffle limits, no all-pairs joins."""

import re

import pytest

from quillrank.plans import load_all
from tests.conftest import SF001

REG = load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def full_plan(df) -> str:
    # Includes the final adaptive plan once the query has run.
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REG.ORACLE))
def test_no_all_pairs_joins(spark, name):
    p = plan(REG.QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_scan_pruning_and_pushdown(spark):
    p = plan(REG.QUERIES["page_features"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in p
    # Key lookups read only the url column of the pages table.
    p = plan(REG.QUERIES["existence_report"](spark, SF001))
    assert "ReadSchema: struct<url:string>" in p and "html" not in p


def test_dedup_is_partially_aggregated(spark):
    p = full_plan(REG.QUERIES["dedup_pages"](spark, SF001))
    assert "partial_min(" in p


def test_top_k_is_limited_before_shuffle(spark):
    p = full_plan(REG.QUERIES["title_search_top3"](spark, SF001))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_means_are_one_partial_aggregate(spark):
    p = full_plan(REG.QUERIES["feature_means"](spark, SF001))
    assert p.count("partial_avg") >= 1 and "Expand" not in p


def test_spread_only_where_the_session_asks(spark):
    from quillrank.sources import spread
    from quillrank.sources.tables import SPREAD
    df = spark.range(0, 1000, numPartitions=1)
    assert spread(df) is df
    spark.conf.set(SPREAD, "8")
    try:
        assert spread(df).rdd.getNumPartitions() == 8
    finally:
        spark.conf.unset(SPREAD)


def test_building_a_query_measures_nothing(spark):
    """Only file footers are read while a plan is built."""
    from quillrank.plans import corpus
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    for build in (corpus.labelled_doc_table, corpus.labelled_html_table, corpus.doc_feature_table):
        build(spark, SF001, ["pageId", "grade_level"])
    jobs = tracker.getJobIdsForGroup("build")
    stages = [tracker.getStageInfo(x) for j in jobs for x in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("default", "default")
    assert all(x is None or x.numTasks == 1 for x in stages)


def test_first_captures_parse_html_once(spark):
    p = plan(REG.QUERIES["dedup_pages"](spark, SF001))
    assert len(re.findall(r"ReadSchema: struct<[^>]*html", p)) == 1


def test_materialize_cuts_lineage(spark):
    from quillrank.sources import materialize
    df = materialize(spark.range(100).selectExpr("id", "id * 2 AS x"))
    logical = df._jdf.queryExecution().logical().toString()
    assert "LogicalRDD" in logical and "Range" not in logical


def test_labelled_tables_cut_scans_before_measuring(spark):
    from pyspark.sql import functions as F

    from quillrank.plans import corpus
    for fast_table, full_table, cols in ((corpus.labelled_doc_table, corpus.doc_feature_table, ["pageId", "grade_level", "nWordsSummary"]),
                                         (corpus.labelled_html_table, corpus.html_feature_table, ["pageId", "title", "nLinks"])):
        fast = fast_table(spark, SF001, cols)
        assert "LeftSemi" in plan(fast)
        full = full_table(spark, SF001, cols).where(F.col("featured") | F.col("flagged"))
        assert fast.exceptAll(full).count() == 0 and full.exceptAll(fast).count() == 0


@pytest.mark.parametrize("name", ["training_rows", "train_test_split", "confusion_metrics", "standardize"])
def test_usable_rows_are_measured_once(spark, name):
    """The filter on measures reads stored ones: below the projection it would work them out again for each condition."""
    df = REG.QUERIES[name](spark, SF001)
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
