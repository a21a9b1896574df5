"""Parquet table access with explicit column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet`` keeping only ``columns``.

    The select sits directly on the scan so the parquet reader gets the pruned
    ReadSchema and any later filter becomes a PushedFilter.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Session setting: deal scans out to so many partitions before measuring texts.
SPREAD = "spark.quillrank.spread"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition where the session asks for it, else ``df`` itself.

    Text measures are CPU bound, and a file of one row group is read by one
    task; a local session asks to deal its rows out. Tables of many row groups
    are split by ``spark.sql.files.maxPartitionBytes`` and need no shuffle.
    """
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions)) if partitions else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used where an expensive frame (the per-page features) feeds several jobs
    or filters: without it Catalyst pushes filters through the feature
    projection (re-evaluating the text expressions) and every scalar subquery
    or model fit recomputes the features. A reliable checkpoint (not a local
    one) survives the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
