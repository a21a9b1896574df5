"""Golden rows (FIXTURES.md §3) for the quirk-exact rules."""

import math

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators import buckets as BK
from quillrank.operators import links as LK
from quillrank.operators import tables as TB
from quillrank.operators.features import extract_features
from quillrank.operators.reports import display_score

MEASURES = ["nSents", "meanSentLength", "medianSentLength", "meanWordLength", "medianWordLength", "nChars", "nSections"]


def _records(spark, contents):
    rows = [(i, i, c) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "id long, page_id long, content string")
    return df.select("id", "page_id", F.lit(None).cast("long").alias("revision_id"), F.lit("u").alias("url"),
                     F.lit("t").alias("title"), "content", F.col("content").alias("summary"),
                     F.array().cast("array<string>").alias("links"), F.array().cast("array<string>").alias("images"),
                     F.array().cast("array<string>").alias("references"))


BODY_CASES = [
    ("One two. Three four five.", "One two. Three four fiv", 2, 2.5, 2.5, 3.8, 4.0, 23, 1),
    ("Intro text here. More.\n\n== History ==\nOld things happened.\n\n== Notes and references ==\nref 1",
     "Intro text here. More.\n\n== History ==\nOld things happened.\n\n==", 4, 2.75, 2.0, 4.545454545454546, 5.0, 51, 3),
    ("Notes and references only", "Notes and references onl", 1, 4.0, 4.0, 5.25, 4.0, 24, 1),
]


def test_body_cut_and_measures(spark):
    df = _records(spark, [c[0] for c in BODY_CASES])
    bodies = [r[0] for r in df.orderBy("id").select(T.body_cut(F.col("content"))).collect()]
    assert bodies == [c[1] for c in BODY_CASES]
    got = extract_features(df, MEASURES).orderBy("id").collect()
    for row, case in zip(got, BODY_CASES):
        n, ms, mds, mw, mdw, nc, nsec = case[2:]
        assert row["nSents"] == n and row["nChars"] == nc and row["nSections"] == nsec
        assert math.isclose(row["meanSentLength"], ms) and math.isclose(row["medianSentLength"], mds)
        assert math.isclose(row["meanWordLength"], mw) and math.isclose(row["medianWordLength"], mdw)


STRIP_CASES = [
    ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmn"),
    ("Lead paragraph text.\n\n== See also ==\nx\n\n== References ==\ny", "Lead paragraph text"),
    ("Short text", ""),
]


def test_back_matter_strip(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STRIP_CASES)], "id long, t string")
    got = [r[0] for r in df.orderBy("id").select(T.strip_back_matter(F.col("t"))).collect()]
    assert got == [e for _, e in STRIP_CASES]


def test_short_text_has_null_readability(spark):
    row = extract_features(_records(spark, ["Short text"]), ["grade_level", "reading_ease", "nSents"]).first()
    assert row["grade_level"] is None and row["reading_ease"] is None and row["nSents"] == 0


@pytest.mark.parametrize("mx,cases", [
    (99.0, [(-1.0, 0), (0.0, 0), (0.99, 0), (1.0, 1), (97.99, 97), (98.0, 99), (1e6, 99), (float("nan"), 99), (None, 99)]),
    (0.0, [(0.0, 99), (3.0, 99)]),
])
def test_bucketize_golden(spark, mx, cases):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "id long, f double")
    got = [r["f"] for r in BK.bucketize(df, {"f": mx}).orderBy("id").collect()]
    assert got == [b for _, b in cases]


def _loop_bucket(f, mx):
    edges = [i * (mx / 99) for i in range(99)]
    if f is None or (isinstance(f, float) and math.isnan(f)):
        return 99
    for b in range(1, 98 + 1):
        if f < edges[b]:
            return b - 1
    return 99


@pytest.mark.parametrize("mx", [37.3, 512.77, 1234.567])
def test_bucket_edges_land_exactly(spark, mx):
    vals = [b * (mx / 99) for b in range(1, 99)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, f double")
    got = [r["f"] for r in BK.bucketize(df, {"f": mx}).orderBy("id").collect()]
    assert got == list(range(1, 98)) + [99]
    assert got == [_loop_bucket(v, mx) for v in vals]


def test_display_score(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.05, 0.5, 0.95, 1.0])], "id long, s double")
    got = [r[0] for r in df.orderBy("id").select(display_score(F.col("s"))).collect()]
    assert got == [1, 1, 6, 10, 10]


def test_score_rule(spark):
    rows = [(0, True, False, 1.0, 0.37), (1, True, True, 1.0, 0.37), (2, False, True, 1.0, 0.37),
            (3, False, False, None, 0.37), (4, False, False, 1.0, 0.37)]
    df = spark.createDataFrame(rows, "id long, featured boolean, flagged boolean, f double, m double")
    got = [r[0] for r in df.orderBy("id").select(TB.score_rule(F.col("featured"), F.col("flagged"), [F.col("f")], F.col("m"))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.0, 0.37]


def test_dedup_keeps_first_and_all_nulls(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None), (5, 8)], "id long, pageId long")
    assert sorted(r["id"] for r in TB.dedup_first(df).collect()) == [1, 3, 4, 5]


def _page(cells):
    return "<html><body><table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table></body></html>"


def test_list_pages(spark):
    six = _page(["x", "y", "z", "w", '<a href="/A">A</a> <a href="/B">B</a> <a href="/Q">Say &quot;Q&quot; "now"</a>', "v"])
    five = _page([f'<a href="/L{i}">L{i}</a>' for i in range(1, 6)])
    four = _page(['<a href="/M1">M1</a>', "b", "c", "d"])
    two = _page(['<a href="/N1">N1</a>', '<a href="/N2">N2</a>'])
    pages = spark.createDataFrame([(1, "u1", six), (2, "u2", five), (3, "u3", four), (4, "u4", two)],
                                  "id long, url string, html string")
    good = LK.featured_links(pages).orderBy("source_id", "position").collect()
    assert [(r["source_id"], r["title"]) for r in good] == [(1, "A"), (1, "B"), (1, "Say Q now"), (2, "L5")]
    bad = LK.flagged_links(pages).where("source_id IN (2, 4)").orderBy("source_id", "position").collect()
    assert [(r["source_id"], r["href"]) for r in bad] == [(2, "/L3"), (2, "/L4"), (2, "/L5"), (4, "/N1"), (4, "/N2")]
    assert LK.featured_links(pages).where("source_id IN (3, 4)").count() == 0


def test_remeasure_update(spark):
    stored = spark.createDataFrame([(1, 1, 9.0, 60.0, True, False), (2, 2, 9.0, 60.0, False, True),
                                    (3, 3, 9.0, 60.0, True, False), (4, 4, 9.0, 60.0, False, False)],
                                   "id long, pageId long, grade_level double, reading_ease double, featured boolean, flagged boolean")
    new = spark.createDataFrame([(1, 8.0, 65.0), (2, 8.0, None), (3, None, 65.0), (4, 1.0, 1.0)],
                                "pageId long, grade_level double, reading_ease double")
    got = {r["id"]: (r["grade_level"], r["reading_ease"]) for r in TB.remeasure_update(stored, new).collect()}
    assert got == {1: (8.0, 65.0), 2: (8.0, 60.0), 3: (9.0, 60.0), 4: (9.0, 60.0)}


def test_lookup_by_title_first_row_and_case(spark):
    stored = spark.createDataFrame([(5, "Cat"), (3, "Cat"), (9, "cat"), (4, "Dog")], "id long, title string")
    phrases = spark.createDataFrame([(1, "Cat"), (2, "CAT"), (3, "Eel")], "pid long, title string")
    exact = {r["pid"]: (r["doc_id"], r["n_same_title"]) for r in TB.lookup_by_title(phrases, stored).collect()}
    assert exact == {1: (3, 2)}
    loose = {r["pid"]: (r["doc_id"], r["n_same_title"]) for r in TB.lookup_by_title(phrases, stored, case_insensitive=True).collect()}
    assert loose == {1: (3, 3), 2: (3, 3)}


def test_title_and_introduction_are_whole(spark):
    """The title is the whole first line; the introduction goes up to the first heading."""
    from quillrank.sources.records import first_line, html_records_from, introduction
    text = "A title of far more than sixty characters, which earlier was cut in the middle of a word\nSecond line\n\n== History ==\nOld"
    df = spark.createDataFrame([(text,), ("no heading\nat all",), ("== Only ==\nx",), ("",), (None,)], "c string")
    got = [tuple(r) for r in df.select(first_line(F.col("c")), introduction(F.col("c"))).collect()]
    assert got == [(text.split("\n")[0], text.split("\n\n==")[0]), ("no heading", "no heading\nat all"), ("== Only ==", ""), ("", ""), (None, None)]
    page = "<html><title>T</title><body><article><p>A</p><p>B b</p><h2>H</h2><p>C</p></article></body></html>"
    row = html_records_from(spark.createDataFrame([(1, "/en/7", page)], "page_id long, url string, html string")).first()
    assert row.summary.split() == ["A", "B", "b"]


def test_long_hyphenated_words(spark):
    """A word of 100,000 parts is one word; a repeated group would overflow the JVM's stack."""
    import re

    from quillrank.functions.readability import read_tokens
    rows = ["a-" * 100_000 + "a b", "it's a-b 'q' x--y z- -w rock'n'roll \ue000m", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(F.size(read_tokens(F.col("t")))).collect()]
    assert got[:3] == [2, len(re.findall(r"[^\W_]+(?:['-][^\W_]+)*", rows[1])), 0]


def test_cluster_sessions_must_name_a_shared_folder():
    from types import SimpleNamespace

    from quillrank.session import ensure_checkpoint_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_html_forms(spark):
    """All articles, unclosed elements, pages without a body, and the three ways to write an href."""
    from quillrank.sources.records import html_records_from
    pages = ["<body><article><p>A</p></article><p>no</p><article><p>B</p></article></body>", "<html><body><p>C", "<title>T</title><p>D</p>", "",
             """<body><a href="/x">1</a><a class=k href='/y'>2</a><a href=/z>3</a><a href = "http://e.x/'q'">4</a></body>"""]
    rows = html_records_from(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).orderBy("id").collect()
    assert [r.content.split() for r in rows[:4]] == [["A", "B"], ["C"], ["D"], []]
    assert rows[4].links == ["/x", "/y", "/z"] and rows[4].references == ["http://e.x/'q'"]
    assert [r.href for r in LK.page_links(spark.createDataFrame([(1, "u", pages[4])], "id long, url string, html string")).orderBy("position").collect()] == ["/x", "/y", "/z", "http://e.x/'q'"]
