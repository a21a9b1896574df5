"""Hot keys: one key holding a third of all rows must not change results."""

from pyspark.sql import functions as F

from quillrank.operators import search as SE
from quillrank.operators import tables as TB


def test_dedup_and_existence_with_hot_key(spark):
    n = 30000
    df = spark.range(n).select(F.col("id"),
                               F.when(F.col("id") % 3 == 0, F.lit(42)).otherwise(F.col("id")).alias("pageId"))
    out = TB.dedup_first(df)
    assert out.count() == n - (n // 3) + 1
    assert out.where("pageId = 42").first()["id"] == 0
    ids = spark.createDataFrame([(42,), (1,), (3,)], "page_id long")
    rep = {r["page_id"]: (r["n_copies"], r["in_table"]) for r in TB.existence_report(ids, df).collect()}
    assert rep == {42: (n // 3, 1), 1: (1, 1), 3: (0, 0)}


def test_search_with_hot_prefix(spark):
    titles = spark.range(20000).select(F.col("id"), F.concat(F.lit("the "), F.col("id").cast("string")).alias("title"))
    phrases = spark.createDataFrame([(1, "The"), (2, "the 7"), (3, "zzz")], "phrase_id long, phrase string")
    got = sorted(tuple(r) for r in SE.search_titles(phrases, titles).collect())
    # "the": the three shortest titles, ties by id: "the 0", "the 1", "the 2".
    assert [g for g in got if g[0] == 1] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert [g for g in got if g[0] == 2] == [(2, 1, 7)]
    assert not [g for g in got if g[0] == 3]
