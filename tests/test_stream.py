"""Streaming ingest equals the batch plan and is idempotent on replay."""

import shutil

from pyspark.sql import functions as F

from quillrank.plans import load_all
from quillrank.plans.corpus import labels_table
from quillrank.streaming import ingest as ING
from tests.conftest import SF001


def test_ingest_replay_is_idempotent(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    shutil.copy(f"{SF001}/pages.parquet", src / "pages.parquet")
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    labels = labels_table(spark, SF001)
    ING.start_ingest(spark, str(src), "pages.parquet", labels, sink, ckpt).awaitTermination()
    first = spark.read.parquet(sink).count()
    # Replay: a fresh checkpoint re-reads the same file; known keys are skipped.
    ING.start_ingest(spark, str(src), "pages.parquet", labels, sink, str(tmp_path / "ckpt2")).awaitTermination()
    assert spark.read.parquet(sink).count() == first
    # Same checkpoint again: nothing new to process.
    ING.start_ingest(spark, str(src), "pages.parquet", labels, sink, ckpt).awaitTermination()
    assert spark.read.parquet(sink).count() == first
    batch = load_all().QUERIES["dedup_pages"](spark, SF001)
    assert batch.count() == first
    # Equivalence: the streamed sink equals the batch plan row for row.
    streamed = spark.read.parquet(sink).select(*ING.SINK_COLUMNS)
    from quillrank.operators.tables import dedup_first
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    want = dedup_first(ING._features(pages, labels), "pageId", "id").select(*ING.SINK_COLUMNS)
    assert streamed.exceptAll(want).count() == 0 and want.exceptAll(streamed).count() == 0


def test_ingest_with_fitted_model(spark, tmp_path):
    from quillrank.plans import learning as L
    from quillrank.plans.corpus import doc_feature_table
    from quillrank.sources import materialize
    src = tmp_path / "src"
    src.mkdir()
    shutil.copy(f"{SF001}/pages.parquet", src / "pages.parquet")
    t = materialize(doc_feature_table(spark, SF001, ING.SCORE_FEATURES + ["reading_ease"]))
    qm, _ = L.fit_models(t, ING.SCORE_FEATURES, kinds=("rf",))
    sink = str(tmp_path / "sink")
    labels = labels_table(spark, SF001)
    ING.start_ingest(spark, str(src), "pages.parquet", labels, sink, str(tmp_path / "ckpt"),
                     model=qm.models["rf"]).awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert rows and all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert all(r["score"] == 1.0 for r in rows if r["featured"])
    assert all(r["score"] == 0.0 for r in rows if r["flagged"] and not r["featured"])


def test_known_articles_skipped_across_batches(spark, tmp_path):
    """Two files, one per trigger: the second batch repeats every article of the
    first, so it must add nothing (known keys come from the sink)."""
    src = tmp_path / "src"
    src.mkdir()
    shutil.copy(f"{SF001}/pages.parquet", src / "a_pages.parquet")
    shutil.copy(f"{SF001}/pages.parquet", src / "b_pages.parquet")
    sink = str(tmp_path / "sink")
    labels = labels_table(spark, SF001)
    ING.start_ingest(spark, str(src), "*pages.parquet", labels, sink, str(tmp_path / "ckpt"),
                     max_files_per_trigger=1).awaitTermination()
    import os
    offsets = sorted(int(f) for f in os.listdir(tmp_path / "ckpt" / "offsets") if f.isdigit())
    assert offsets[:2] == [0, 1]  # the second file really ran as its own micro-batch
    out = spark.read.parquet(sink)
    per_batch = {r["batch_id"]: r["count"] for r in out.groupBy("batch_id").count().collect()}
    assert sorted(per_batch) == [0] or per_batch.get(1, 0) == 0
    assert out.count() == load_all().QUERIES["dedup_pages"](spark, SF001).count()
    assert out.groupBy("pageId").count().where("count > 1 AND pageId IS NOT NULL").count() == 0


def test_a_fresh_checkpoint_loses_nothing(spark, tmp_path):
    """Two streams with inputs of their own write to one sink; the second starts at batch 0 again."""
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    pages.where("page_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "even"))
    pages.where("page_id % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "odd"))
    sink, labels = str(tmp_path / "sink"), labels_table(spark, SF001)
    ING.start_ingest(spark, str(tmp_path), "even", labels, sink, str(tmp_path / "c1")).awaitTermination()
    first = {r.id for r in spark.read.parquet(sink).collect()}
    ING.start_ingest(spark, str(tmp_path), "odd", labels, sink, str(tmp_path / "c2")).awaitTermination()
    both = spark.read.parquet(sink)
    assert first < {r.id for r in both.collect()}
    assert both.groupBy("pageId").count().where("count > 1 AND pageId IS NOT NULL").count() == 0
    assert both.where("pageId IS NOT NULL").count() == load_all().QUERIES["dedup_pages"](spark, SF001).where("pageId IS NOT NULL").count()


def test_a_table_of_part_files_gives_the_same_rows(spark, tmp_path):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    sink = str(tmp_path / "sink")
    ING.start_ingest(spark, str(tmp_path), "pages.parquet", labels_table(spark, SF001), sink, str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(sink).count() == load_all().QUERIES["dedup_pages"](spark, SF001).count()


def _rows(df):
    return sorted(map(tuple, df.select(*ING.SINK_COLUMNS).collect()), key=str)


def test_two_streams_of_three_batches_and_a_replay(spark, tmp_path):
    """Articles are known by keyed state: in later micro-batches, after a restart, and in a stream that begins on a filled sink."""
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    labels = labels_table(spark, SF001)
    odd = spark.createDataFrame([(9001, "/no/key", "<html><body>a b c. d</body></html>"), (9001, "/no/key", "<html><body>other</body></html>")], ING.PAGES_SCHEMA)
    for name, part in (("one", 0), ("two", 1), ("three", 2)):
        # Overlapping thirds: most articles come more than once.
        pages.where(f"page_id % 3 = {part} OR page_id % 5 = 0").union(odd).orderBy(F.desc("page_id")).coalesce(1).write.parquet(str(tmp_path / "src" / name))
    files = []
    for name in ("one", "two", "three"):
        found = next(f for f in (tmp_path / "src" / name).iterdir() if f.name.endswith(".parquet"))
        target = tmp_path / "in" / f"{len(files)}_pages.parquet"
        target.parent.mkdir(exist_ok=True)
        shutil.copy(found, target)
        files.append(target)
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "c1")
    q = ING.start_ingest(spark, str(tmp_path / "in"), "*pages.parquet", labels, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    batches = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(batches) == 3
    keyed = spark.read.parquet(sink).where("pageId IS NOT NULL")
    assert keyed.groupBy("pageId").count().where("count > 1").count() == 0
    # Captures without an article all stay, in every batch.
    assert spark.read.parquet(sink).where("id = 9001").count() == 6
    # The first capture of the batch that an article came in first.
    first = {}
    for batch, f in enumerate(sorted(files)):
        for r in spark.read.parquet(str(f)).select("page_id", ING.H.url_doc_key(F.col("url")).alias("k")).collect():
            if r.k is not None:
                first[r.k] = min(first.get(r.k, (batch, r.page_id)), (batch, r.page_id))
    assert {(r.pageId, r.id) for r in keyed.collect()} == {(k, i) for k, (_, i) in first.items()}
    # A batch that is run again writes the same rows; a second stream over the same files adds only captures without article.
    before = _rows(spark.read.parquet(sink))
    import os
    for name in ("2", ".2.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    ING.start_ingest(spark, str(tmp_path / "in"), "*pages.parquet", labels, sink, ckpt, max_files_per_trigger=1).awaitTermination()
    assert _rows(spark.read.parquet(sink)) == before
    again = ING.start_ingest(spark, str(tmp_path / "in"), "*pages.parquet", labels, sink, str(tmp_path / "c2"), max_files_per_trigger=1)
    again.awaitTermination()
    assert _rows(spark.read.parquet(sink).where("pageId IS NOT NULL")) == [r for r in before if r[1] is not None]


def test_the_stream_reads_neither_texts_nor_the_sink(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    shutil.copy(f"{SF001}/pages.parquet", src / "pages.parquet")
    sink = str(tmp_path / "sink")
    q = ING.start_ingest(spark, str(src), "pages.parquet", labels_table(spark, SF001), sink, str(tmp_path / "c1"))
    q.awaitTermination()
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        q.explain()
    plans = out.getvalue()
    assert "FlatMapGroupsInPandasWithState" in plans and "html" not in plans and sink not in plans
    state = q.lastProgress["stateOperators"] if q.lastProgress else []
    keys = spark.read.parquet(sink).where("pageId IS NOT NULL").count()
    assert not state or state[0]["numRowsTotal"] >= keys


def test_the_first_capture_is_found_without_work_on_frames(monkeypatch):
    """The state function runs once for each article: it builds and sorts no frames."""
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.exists = True

    def never(*a, **k):
        raise AssertionError("sorted")

    frames = [pd.DataFrame({"page_id": [None, 9, 9], "path": ["a", "c", "b"], "known": [False] * 3}), pd.DataFrame({"page_id": [12], "path": ["a"], "known": [False]})]
    held = pd.DataFrame({"page_id": [None], "path": [None], "known": [True]})
    monkeypatch.setattr(pd.DataFrame, "sort_values", never)
    state = State()
    assert [f.values.tolist() for f in ING._first_capture(("article 1",), iter(frames), state)] == [[[9, "b"]]] and state.exists
    assert list(ING._first_capture(("article 1",), iter(frames), state)) == []
    state = State()
    assert list(ING._first_capture(("article 2",), iter([*frames, held]), state)) == [] and state.exists
    alone = pd.DataFrame({"page_id": [None], "path": ["a"], "known": [False]})
    (only,) = ING._first_capture(("article 3",), iter([alone]), State())
    assert only["page_id"].isna().all() and only["path"].tolist() == ["a"]
