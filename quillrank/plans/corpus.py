"""The feature tables every report and model reads.

``doc_feature_table``: documents → features → labels (the scored population).
``html_feature_table``: captured pages → features → labels by article key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.features import FEATURE_TABLE_COLUMNS, MEASURE_COLUMNS, extract_features
from quillrank.operators.labels import attach_labels
from quillrank.sources import document_records, html_records, read_table


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels", ["doc_id", "quality"])


def _with_key(columns):
    cols = list(columns or MEASURE_COLUMNS)
    return cols if "pageId" in cols else ["pageId"] + cols


def doc_feature_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, only_ids: DataFrame | None = None) -> DataFrame:
    """Features of documents; ``only_ids`` (column ``_keep_id``) cuts them before they are measured."""
    feats = extract_features(document_records(spark, sf_dir, only_ids), _with_key(columns))
    out = attach_labels(feats, labels_table(spark, sf_dir))
    return out.select("id", *[c for c in FEATURE_TABLE_COLUMNS if c in out.columns])


def html_feature_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, records: DataFrame | None = None) -> DataFrame:
    """Features of captures: all, or those of ``records``."""
    feats = extract_features(html_records(spark, sf_dir) if records is None else records, _with_key(columns))
    out = attach_labels(feats, labels_table(spark, sf_dir))
    return out.select("id", *[c for c in FEATURE_TABLE_COLUMNS if c in out.columns])


def _label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labels_table(spark, sf_dir)
    return labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_keep_id")).distinct()


def _labelled(records: DataFrame, spark: SparkSession, sf_dir: str, columns: list[str] | None) -> DataFrame:
    out = attach_labels(extract_features(records, _with_key(columns)), labels_table(spark, sf_dir))
    return out.select("id", *[c for c in FEATURE_TABLE_COLUMNS if c in out.columns]).where(F.col("featured") | F.col("flagged"))


def labelled_html_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Captured pages of labelled articles only, cut before the text measures (as
    ``labelled_doc_table``, keyed by the article key in the url)."""
    return _labelled(html_records(spark, sf_dir, only_ids=_label_keys(spark, sf_dir)), spark, sf_dir, columns)


def labelled_doc_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The feature table restricted to labelled documents (featured or flagged).

    A semi join with the label keys stands below the text measures, so
    unlabelled documents are never measured; Spark chooses how to run it.
    """
    return _labelled(document_records(spark, sf_dir, only_ids=_label_keys(spark, sf_dir)), spark, sf_dir, columns)
