"""Title search and grid suggestions against brute force on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from quillrank.operators import grid as G
from quillrank.operators import search as SE


def test_search_brute_force(spark):
    rnd = random.Random(7)
    words = ["the", "cat", "sat", "on", "a", "mat", "The", "Cat!"]
    titles = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    titles += [(100 + i, "the hot") for i in range(200)] + [(400, None), (401, ""), (402, "one cat in the middle of it")]
    phrases = [(500 + j, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))) for j in range(15)]
    phrases += [(998, "middle CAT"), (997, "hot"), (999, "zzz cat"), (996, "?"), (995, None), (994, "hot")]
    t = spark.createDataFrame(titles, "id long, title string")
    p = spark.createDataFrame(phrases, "phrase_id long, phrase string")
    got = sorted(tuple(r) for r in SE.search_titles(p, t).collect())

    def toks(s):
        import re
        return set(re.findall(r"[^\W_]+", (s or "").lower()))

    want = []
    for pid, ph in phrases:
        hits = sorted((len(ti), i) for i, ti in titles if toks(ph) and toks(ph) <= toks(ti))
        want += [(pid, r + 1, i) for r, (_, i) in enumerate(hits[:3])]
    assert got == sorted(want) and (998, 1, 402) in got


def test_pages_without_a_coordinate_are_kept(spark):
    scored = G.grid_scores(G.grid_points(spark), F.lit(1.0))
    pages = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0), (3, None, 5.0)], "id long, x double, y double")
    got = [(r.id, r["rank"]) for r in G.suggestions(pages, scored, k=2).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, None)]


def test_suggestions_brute_force(spark):
    grid = G.grid_points(spark)
    assert grid.count() == G.GRID_POINTS
    scored = G.grid_scores(grid, (F.col("n_links") + F.col("n_words_summary")) / F.lit(1895.0))
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (250, 700), (499, 1399), (12, 1300), (600, 2000)])]
    pages = spark.createDataFrame(pts, "id long, x double, y double")
    got = {}
    for r in G.suggestions(pages, scored, k=4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["n_links"], r["n_words_summary"], round(r["distance"], 9)))
    good = [(a * 5.0, b * 5.0) for a in range(100) for b in range(280) if (a * 5.0 + b * 5.0) / 1895.0 > 0.9]
    for i, x, y in pts:
        ranked = sorted(good, key=lambda g: (math.sqrt((x - g[0]) ** 2 + (y - g[1]) ** 2), g[0], g[1]))[:4]
        want = [(k + 1, a, b, round(math.sqrt((x - a) ** 2 + (y - b) ** 2), 9)) for k, (a, b) in enumerate(ranked)]
        assert sorted(got[i]) == want


def test_the_plain_search_looks_once_at_each_position(spark):
    scored = G.grid_scores(G.grid_points(spark), (F.col("n_links") + F.col("n_words_summary")) / F.lit(1895.0))
    places = [(0.0, 0.0), (250.0, 700.0), (252.5, 902.5), (499.0, 1399.0), (600.0, 2000.0), (None, 5.0)]
    frame = spark.createDataFrame(places, "x double, y double")
    want = {(r.x, r.y): [tuple(w) for w in r.want] for r in G.plain_suggestions(frame, scored).collect()}
    good = sorted((a * 5.0, b * 5.0) for a in range(100) for b in range(280) if (a * 5.0 + b * 5.0) / 1895.0 > 0.9)
    for x, y in places:
        ranked = sorted(good, key=lambda g: (math.sqrt((x - g[0]) ** 2 + (y - g[1]) ** 2), g)) if x is not None else good
        assert want[x, y] == [(i + 1, *g) for i, g in enumerate(ranked[:5])]
    none = G.plain_suggestions(frame, G.grid_scores(G.grid_points(spark), F.lit(0.0))).collect()
    assert len(none) == len(places) and all(r.want == [] for r in none)


def test_many_captures_are_checked_without_a_fold_over_the_grid(spark):
    from quillrank.plans import load_all
    from tests.conftest import SF001

    df = load_all().QUERIES["grid_suggestions_checked"](spark, SF001)
    plan = df._jdf.queryExecution().toString()
    # No page carries the points of the grid, and pages are parsed before the plan, once for both searches.
    assert "transform(" not in plan and "html" not in plan
    assert df.where("NOT checked").count() == 0 and df.count() == spark.read.parquet(f"{SF001}/pages.parquet").count()


def test_long_titles_are_not_dealt_out_for_every_token(spark, tmp_path):
    """What the search shuffles grows with the titles' tokens, not with their square: only probed tokens carry a title along."""
    titles = [(i, " ".join(f"w{j}" for j in range(i % 50, i % 50 + 300)) + (f" rare{i}" if i % 10 == 0 else "")) for i in range(200)]
    titles += [(7, "w10 other"), (7, "w10 other"), (None, "rare0 w3")]
    phrases = [(1, "w60 rare0"), (2, "rare10"), (3, "other W10"), (4, "rare0 w3"), (5, "w9999")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = SE.search_titles(spark.createDataFrame(phrases, "phrase_id long, phrase string"), spark.createDataFrame(titles, "id long, title string"))
        got = sorted((r.phrase_id, r["rank"], r.doc_id) for r in df.collect())
        nodes, most = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            while (name := node.nodeName()) == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
                node = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan()
            if node.nodeName() == "Exchange" and "held#" in node.output().mkString(","):
                most += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(1, 1, 0), (2, 1, 10), (3, 1, 7), (3, 2, 7), (4, 1, None), (4, 2, 0)]
    assert 0 < most < 1000  # with every token of every title: some 60,000
