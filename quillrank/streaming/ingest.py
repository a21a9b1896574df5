"""Incremental page ingest with Structured Streaming.

New capture files arrive in a folder → PageRecord → features → labels →
score rule → appended to the feature table.

The stream itself reads only urls and ids. Which articles are known is keyed
state of the stream: a state store, dealt over the tasks by article and
versioned with the checkpoint, remembers every article once, so the cost of a
micro-batch does not grow with what was ingested before, and the sink is not
read. Of an article's captures in its first micro-batch the one with the
smallest id is new; only new captures are then read in full and measured.

A stream that begins on a sink with rows (a new checkpoint) first takes the
sink's articles into its state: they are written beside the checkpoint once
and read as a second source, all of it in the first micro-batch. One stream
writes to a sink at a time.

Each micro-batch writes its own ``stream_id=S/batch_id=N`` partition with
overwrite, so a replayed batch (whose state is that before it) replaces itself
instead of appending twice. The stream's name is kept in its checkpoint
folder, which replaces the resume offset.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillrank.functions import html as H
from quillrank.operators.features import extract_features
from quillrank.operators.labels import attach_labels
from quillrank.operators.tables import score_rule, standin_score
from quillrank.plans.learning import probability
from quillrank.session import is_folder, path_exists
from quillrank.sources import materialize
from quillrank.sources.records import html_records_from

PAGES_SCHEMA = "page_id long, url string, html string"
#: Capture files of a micro-batch, unless the caller says otherwise (their paths come to the driver).
FILES_PER_TRIGGER = 1000
SCORE_FEATURES = ["nWordsSummary", "nSents", "meanSentLength", "meanWordLength", "grade_level"]
SINK_COLUMNS = ["id", "pageId", "title", "url", "nWordsSummary", "nSents", "meanSentLength", "meanWordLength",
                "grade_level", "reading_ease", "featured", "flagged", "score"]


def _features(df: DataFrame, labels: DataFrame, model=None) -> DataFrame:
    """Features, labels and the score rule; the rule's model term is the fitted
    pipeline's P(high quality) when ``model`` is given, else the stand-in."""
    feats = extract_features(html_records_from(df), ["pageId", "title", "url"] + SCORE_FEATURES + ["reading_ease"])
    t = attach_labels(feats, labels)
    if model is not None:
        t = probability(model, t)
        p = F.col("p_high")
    else:
        p = standin_score(F.col("reading_ease"))
    rule = score_rule(F.col("featured"), F.col("flagged"), [F.col(c) for c in SCORE_FEATURES], p)
    return t.withColumn("score", rule).select(*SINK_COLUMNS)


def new_captures(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """The first capture (smallest id) of each article in ``batch`` that ``known`` (column ``pageId``) lacks.

    Worked out from the url and id columns; texts are only read for what is
    left. Captures without an article key all stay. No join is hinted: Spark
    picks one by the sizes it sees.
    """
    key = H.url_doc_key(F.col("url"))
    keyed = batch.select(key.alias("_key"), F.col("page_id").alias("_id"))
    first = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_id").alias("_id"))
    if known is not None:
        first = first.join(known.select(F.col("pageId").alias("_key")), "_key", "left_anti")
    wanted = first.select("_id").union(keyed.where(F.col("_key").isNull()).select("_id"))
    return batch.join(wanted, batch["page_id"] == wanted["_id"], "left_semi")


def _first_capture(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first capture of an article that the state doesn't hold; all captures without an article."""
    if not key[0].startswith("article"):
        yield from (f[["page_id", "path"]] for f in frames)
        return
    # A group is a few rows mostly, one for each article: plain lists, no work on frames.
    first, known = None, state.exists
    for f in frames:
        known = known or any(f["known"].tolist())
        if not known:
            least = min(zip(f["page_id"].tolist(), f["path"].tolist(), strict=True), key=_capture_order)
            first = least if first is None else min(first, least, key=_capture_order)
    if not state.exists:
        state.update((True,))
    if not known:
        yield pd.DataFrame({"page_id": pd.array([None if pd.isna(first[0]) else int(first[0])], "Int64"), "path": [first[1]]})


def _capture_order(capture: tuple) -> tuple:
    """By id, nulls last, then by path."""
    unknown = pd.isna(capture[0])
    return unknown, 0 if unknown else capture[0], capture[1]


def unknown_captures(captures: DataFrame, known: DataFrame) -> DataFrame:
    """Stream of (page_id, path) of captures to ingest, from streams of captures (page_id, url, path) and of known articles (pageId)."""
    article = H.url_doc_key(F.col("url")).cast("string")
    seen = captures.select(F.coalesce(F.concat(F.lit("article "), article), F.concat(F.lit("capture "), F.col("page_id").cast("string"), F.lit(" "), "path"), F.lit("capture")).alias("key"),
                           "page_id", "path", F.lit(False).alias("known"))
    held = known.where("pageId IS NOT NULL").select(F.concat(F.lit("article "), F.col("pageId").cast("string")).alias("key"), F.lit(None).cast("long").alias("page_id"),
                                                     F.lit(None).cast("string").alias("path"), F.lit(True).alias("known"))
    return seen.union(held).groupBy("key").applyInPandasWithState(_first_capture, "page_id long, path string", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_batch(new: DataFrame, batch_id: int, sink: str, labels: DataFrame, model=None, stream: str = "stream") -> None:
    """foreachBatch body: read the new captures (page_id, path) in full, measure, idempotent write.

    A micro-batch owns the sink partition of its stream and number: when it is
    replayed it replaces itself, and another stream (a new checkpoint) never
    touches it.
    """
    spark = new.sparkSession
    new = materialize(new)  # the state is asked once
    paths = [r["path"] for r in new.select("path").distinct().collect()]
    if not paths:
        return
    pages = spark.read.schema(PAGES_SCHEMA).parquet(*paths).select("*", F.col("_metadata.file_path").alias("path"))
    wanted = new.select(F.col("page_id").alias("_id"), F.col("path").alias("_path")).distinct()
    rows = pages.join(wanted, pages["page_id"].eqNullSafe(F.col("_id")) & (F.col("path") == F.col("_path")), "left_semi")
    (_features(rows.drop("path"), labels, model).withColumns({"stream_id": F.lit(stream), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("stream_id", "batch_id").parquet(sink))


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that owns a checkpoint folder, kept in a file there; a new folder gets a new one."""
    path = os.path.join(checkpoint, "sink-stream")
    if not path_exists(spark, path):
        spark.createDataFrame([(f"s{uuid.uuid4().hex[:16]}",)], "name string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def known_articles(spark: SparkSession, sink: str, checkpoint: str) -> str:
    """The folder with the articles that the sink held when the stream of a checkpoint began (written once)."""
    path = os.path.join(checkpoint, "known-articles")
    if not path_exists(spark, os.path.join(path, "_SUCCESS")):
        held = spark.read.parquet(sink).select("pageId").distinct() if path_exists(spark, sink) else spark.createDataFrame([], "pageId long")
        held.write.mode("overwrite").parquet(path)
    return path


def start_ingest(spark: SparkSession, source_dir: str, glob: str, labels: DataFrame, sink: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int = FILES_PER_TRIGGER, model=None):
    """Start the ingest stream over ``{source_dir}/{glob}`` (files, or folders of
    part files); ``availableNow`` processes what is there and stops.

    ``model`` (a fitted quality PipelineModel over SCORE_FEATURES) scores each
    micro-batch with the forest; without it the transparent stand-in is used.
    """
    stream = stream_name(spark, checkpoint)
    reader = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    table = f"{source_dir.rstrip('/')}/{glob}"
    # A stream reads folders: a table of part files is one, single files are picked out of theirs.
    pages = reader.parquet(table) if is_folder(spark, table) else reader.option("pathGlobFilter", glob).parquet(source_dir)
    known = spark.readStream.schema("pageId long").parquet(known_articles(spark, sink, checkpoint))
    captures = pages.select("page_id", "url", F.col("_metadata.file_path").alias("path"))
    writer = (unknown_captures(captures, known).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: ingest_batch(df, bid, sink, labels, model, stream)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
