"""One test per fixed quirk and the clean variants of the kept ones."""

from pyspark.sql import functions as F

from quillrank.functions import html as H
from quillrank.functions import text as T
from quillrank.operators import links as LK
from quillrank.operators import search as SE
from quillrank.operators import tables as TB
from quillrank.plans import learning as L


def test_q3_rescore_guard_is_neither(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, True), (4, False, False)],
                               "id long, featured boolean, flagged boolean")
    assert [r["id"] for r in TB.rescore_candidates(df).collect()] == [4]


def test_q4_rule_order_holds_for_stored_integers(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 0)], "id long, featured int, flagged int")
    rule = TB.score_rule(F.col("featured"), F.col("flagged"), [F.lit(1.0)], F.lit(0.42))
    got = {r["id"]: r["s"] for r in df.select("id", rule.alias("s")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.42}


def test_q6_label_featured_wins(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False)], "id long, featured boolean, flagged boolean")
    assert {r["id"]: r["label"] for r in L.with_label(df).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_q10_null_and_nan_features_score_zero(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 2.0)], "id long, f double")
    rule = TB.score_rule(F.lit(False), F.lit(False), [F.col("f")], F.lit(0.7))
    assert {r["id"]: r["s"] for r in df.select("id", rule.alias("s")).collect()} == {1: 0.0, 2: 0.0, 3: 0.7}


def test_q20_first_scored_hit_in_rank_order(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 13)], "phrase_id long, rank int, doc_id long")
    scores = spark.createDataFrame([(10, None), (11, 0.3), (12, 0.9), (13, None)], "id long, score double")
    got = [tuple(r) for r in SE.first_scored(hits, scores).collect()]
    assert got == [(1, 2, 11, 0.3)]


def test_q7_q8_every_link_once(spark):
    html = '<p><a href="/A">A</a><a href="/B">B "b"</a><a href="/A">A</a></p>'
    pages = spark.createDataFrame([(1, "u", html)], "id long, url string, html string")
    got = [(r["position"], r["href"], r["title"]) for r in LK.page_links(pages).orderBy("position").collect()]
    assert got == [(0, "/A", "A"), (1, "/B", "B b"), (2, "/A", "A")]


def test_q1_clean_variants(spark):
    df = spark.createDataFrame([("abcdef",), ("x\\n\\n== See also ==\\ny",)], "t string")
    rows = df.select(T.body_cut(F.col("t"), exact=False).alias("b"),
                     T.strip_back_matter(F.col("t"), exact=False).alias("s")).collect()
    assert rows[0]["b"] == "abcdef" and rows[0]["s"] == "abcdef"


def test_a_missing_value_has_an_empty_bar(spark):
    """max(min(None, hi), lo) is lo: the bar of a page without the value ends where it begins."""
    from quillrank.operators import reports as RP
    rows = [(1, None, 250, 0, 30, 0, None, True, False), (2, 99.0, 600, 10, None, 5, 50.0, False, False), (3, float("nan"), -5, 100, 500, 25, 10.0, False, True)]
    t = spark.createDataFrame(rows, "id long, grade_level double, nLinks int, nRefs int, nWordsSummary int, nImages int, reading_ease double, featured boolean, flagged boolean")
    got = {(r.id, r.feature): (r.frac, r.x_page) for r in RP.page_report(t, ["id"]).collect()}
    assert got[1, "grade_level"] == (0.0, 0.0) and got[2, "nWordsSummary"] == (0.0, 0.0) and got[3, "grade_level"] == (0.0, 0.0)
    assert got[1, "nLinks"] == (0.5, 175.0) and got[2, "grade_level"] == (1.0, 350.0) and got[3, "nLinks"] == (0.0, 0.0)
    assert got[3, "nImages"] == (0.5, 175.0) and got[3, "nWordsSummary"] == (1.0, 350.0)


def test_a_page_without_ease_has_no_standin_score(spark):
    from quillrank.operators.tables import standin_score
    t = spark.createDataFrame([(None,), (50.0,), (250.0,), (-3.0,), (float("nan"),)], "e double")
    assert [r.s for r in t.select(standin_score(t.e).alias("s")).collect()] == [0.0, 0.5, 1.0, 0.0, 0.0]


def test_csv_gives_back_the_rows(spark, tmp_path):
    from quillrank.sources import read_csv, write_csv
    texts = [None, "", "a\rb", "a\nb", "a\r\nb", 'q"q', '""', "back\\", '\\"x', ", ;", " sp ", "\\N", "é漢", "\n", "\r", '","', "NULL", "#x"]
    rows = [(i, t, None if i % 2 else 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, title string, x double").repartition(3)
    write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == rows


def test_new_pages_by_id_or_else_by_title(spark):
    from quillrank.operators.tables import new_pages
    stored = spark.createDataFrame([(1, "A"), (2, None), (None, "C")], "pageId long, title string")
    wanted = [(1, "x"), (7, "A"), (None, "A"), (None, "B"), (None, "C"), (None, None), (2, None)]
    got = new_pages(spark.createDataFrame(wanted, "page_id long, title string"), stored, title="title").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, "A"), (None, "B"), (None, None)], key=str)


def test_stored_scores_come_before_new_ones(spark):
    from quillrank.operators.search import lookup_or_score
    stored = spark.createDataFrame([(1, "A", 0.25), (2, "B", None), (3, "T", 0.5), (4, "T", 0.75)], "pageId long, title string, score double")
    wanted = spark.createDataFrame([(10, 1, "z"), (11, 2, "B"), (12, None, "T"), (13, None, "none"), (14, 9, "A"), (15, None, None)], "id long, page_id long, title string")
    asked = []

    def score(missing):
        asked.extend(r.id for r in missing.collect())
        return missing.selectExpr("id", "0.125D AS score")

    got = {r.id: (r.pageId, r.found, r.score) for r in lookup_or_score(wanted, stored, score).collect()}
    assert sorted(asked) == [11, 13, 14, 15]
    assert got == {10: (1, True, 0.25), 11: (2, True, 0.125), 12: (None, True, 0.5), 13: (None, False, 0.125), 14: (9, False, 0.125), 15: (None, False, 0.125)}


def test_images_in_any_quotes_and_article_keys_of_any_language(spark):
    html = """<img src="a.png"><img alt='x' src='b.png'><IMG src=c.png><img alt="no source">"""
    urls = ["https://x.org/en/12", "https://x.org/zh-yue/13", "https://x.org/simple/14", "https://x.org/als/15", "https://x.org/page/16"]
    got = spark.createDataFrame([(html, u) for u in urls], "html string, url string").select(H.html_images(F.col("html")).alias("images"), H.url_doc_key(F.col("url")).alias("key")).collect()
    assert [r.key for r in got] == [12, 13, 14, 15, None]
    assert got[0].images == ["a.png", "b.png", "c.png"]
