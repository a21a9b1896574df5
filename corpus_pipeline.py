"""A training corpus from ``documents``, in stages.

Each stage takes the rows that the one before it kept, as a stored table, and
returns the columns of ``documents``; the last one returns what its token
files hold. ``run`` writes the rows between stages to the shared folder of
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import decontamination, importance, mixing, simhash, token_shards
from quillrank.llm.common import table
from quillrank.llm.queries import TOKENIZER
from quillrank.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; what it does not sample goes."""
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mix(docs, F.array("source"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the corpus; the documents as read back from them.

    Workers still hold memory of the stages before, so the encoder gets less.
    """
    return token_shards.token_output(docs, public_tokenizers.path(TOKENIZER), group_bytes=1 << 20, remembered=150_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Learned weights, seeded draws and token files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
