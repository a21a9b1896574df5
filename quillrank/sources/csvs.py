"""CSV files that give back the rows they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# All values stand in quotes, which are doubled inside them, so line ends of
# any kind, separators, quotes and backslashes stay what they are. A null is
# the one value without quotes' content that no text is written as.
_OPTIONS = {"header": True, "quoteAll": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False, "nullValue": "\x00", "emptyValue": "", "multiLine": True}


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append (or as ``mode`` says) ``df`` to the CSV folder ``path``, with a header in each file."""
    df.write.mode(mode).options(**_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a CSV folder. Values may span lines, so a file is read by one task: keep files moderate."""
    return spark.read.schema(schema).options(**_OPTIONS).csv(path)
