"""Labels: flag dictionary (E4/J5), ingest label rule (E7), label join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Flag category names and their codes.
FLAG_CODES = [
    ("Too few wikilinks", 1),
    ("In need of updating", 2),
    ("May contain original research", 3),
    ("Stubs", 4),
    ("Need factual verification", 5),
    ("Need cleanup after translation", 6),
    ("Need copy editing", 7),
    ("Introduction cleanup", 8),
    ("Missing lead section", 9),
    ("To be expanded", 10),
]
# Every low-quality list used for intake is of this category.
DEFAULT_FLAG = "Missing lead section"


def flag_dimension(spark: SparkSession) -> DataFrame:
    """10-row dimension (flag_name, flag_code); small and fixed, safe to broadcast."""
    return spark.createDataFrame(FLAG_CODES, "flag_name string, flag_code int")


def flag_code(name: str) -> int:
    return dict(FLAG_CODES)[name]


def label_rows(labels: DataFrame, flag_name: str = DEFAULT_FLAG) -> DataFrame:
    """``labels`` (doc_id, quality) → (label_id, flags, flagged, featured, score).

    quality 1 = a known-good (featured) page; quality 0 = a flagged page with
    the given flag category. E7: flagged pages get score 0; others no score.
    """
    code = flag_code(flag_name)
    flags = F.when(F.col("quality") == 0, F.lit(code))
    return labels.select(
        F.col("doc_id").alias("label_id"),
        flags.cast("int").alias("flags"),
        flags.isNotNull().alias("flagged"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("featured"),
        F.when(flags.isNotNull(), F.lit(0.0)).alias("score"),
    )


def attach_labels(features: DataFrame, labels: DataFrame, key: str = "pageId") -> DataFrame:
    """J8 + E7: left join label rows on the article key; unlabelled pages get
    flags null, flagged/featured false and a null score.

    The join lets the planner choose: a labels table under the broadcast
    threshold (checked from its statistics) is broadcast, a larger one is
    shuffled on the key.
    """
    lr = label_rows(labels)
    j = features.join(lr, features[key] == lr["label_id"], "left").drop("label_id")
    return (
        j.withColumn("flagged", F.coalesce(F.col("flagged"), F.lit(False)))
        .withColumn("featured", F.coalesce(F.col("featured"), F.lit(False)))
    )
