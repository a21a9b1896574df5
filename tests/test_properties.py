"""Property tests: body cut, back-matter strip and bucketize against short Python statements of each rule."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.functions import patterns as P
from quillrank.functions import text as T
from quillrank.operators import buckets as BK

ALPHABET = st.sampled_from(list("ab. =\n") + ["Notes and references", "== See also ==", "== References =="])
TEXTS = st.lists(ALPHABET, max_size=12).map("".join)


def py_body(c):
    i = c.find(P.NOTES_MARKER)
    return c[0:i - 1]


def py_strip(t):
    for m in P.BACK_MATTER_MARKERS:
        t = t[0:t.find(m)]
    return t


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_body_and_strip_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = df.orderBy("id").select(T.body_cut(F.col("t")).alias("b"), T.strip_back_matter(F.col("t")).alias("s")).collect()
    assert [r["b"] for r in got] == [py_body(t) for t in texts]
    assert [r["s"] for r in got] == [py_strip(t) for t in texts]


def py_bucket(f, mx):
    edges = [i * (mx / 99) for i in range(99)]
    if f is None or math.isnan(f):
        return 99
    for b in range(1, 99):
        if f < edges[b]:
            return b - 1
    return 99


@settings(max_examples=25, deadline=None)
@given(st.floats(min_value=0.0, max_value=5000.0), st.lists(st.floats(min_value=-50, max_value=6000), min_size=1, max_size=30))
def test_bucketize_matches_loop(spark, mx, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, f double")
    got = [r["f"] for r in BK.bucketize(df, {"f": mx}).orderBy("id").collect()]
    assert got == [py_bucket(v, mx) for v in values]


def test_new_pages_skips_stored_titles(spark):
    from quillrank.operators.tables import new_pages

    stored = spark.createDataFrame([(1, "A"), (2, None)], "pageId long, title string")
    pages = spark.createDataFrame([(1, "B"), (3, "A"), (4, "C"), (5, None)], "page_id long, name string")
    assert sorted(r.page_id for r in new_pages(pages, stored).collect()) == [3, 4, 5]
    assert sorted(r.page_id for r in new_pages(pages, stored, title="name").collect()) == [4, 5]
