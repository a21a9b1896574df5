"""Connected components of a link table, by rounds of joins in Spark.

Alternating large-star and small-star steps: every node links its larger
neighbours to its smallest one, then its smaller neighbours and itself to the
smallest. The links never grow in number, and the rounds are few (logarithmic
in practice). A node with very many neighbours is only ever aggregated by
``min``, which combines on the map side, and joined, which adaptive execution
splits; its neighbours are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour ``b`` of a node ``a`` to the smallest of ``a`` and its neighbours."""
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = pairs.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``links`` (columns a, b)."""
    down = F.col("a") > F.col("b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(down).distinct())
    while True:
        n, children = links.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        # Stars: every node has one smaller neighbour, and that has none.
        if n == children and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        links = stored(_star(_star(_both_ways(links), large=True), large=False))
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
