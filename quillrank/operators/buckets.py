"""Feature buckets (A2, M1-M3).

Maxima: avg + population std of each feature over featured pages, all from
one aggregate. Edges: e_i = i * (max / 99), i = 0..98 (left edges of 99
bins). Bucket of f: n = #{i in 1..98 : e_i <= f}, 99 when n = 98; null/NaN
→ 99; max = 0 → every f >= 0 lands in 99.

The bucket is a closed-form expression (floor(f / step) corrected by one
step against the exact edges), so bucketing stays a codegen'd scalar
expression instead of a 98-element lambda per value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_EDGES = 99          # 100 linspace points minus the last
LAST_BUCKET = 99      # bucket 98 never occurs


def maxima_frame(table: DataFrame, features: list[str], population: str = "featured") -> DataFrame:
    """(feature, mean, std, max) over ``population`` rows; one global aggregate."""
    aggs = []
    for f in features:
        x = F.when(F.col(population), F.col(f).cast("double"))
        aggs += [F.avg(x).alias(f"{f}__m"), F.stddev_pop(x).alias(f"{f}__s")]
    wide = table.agg(*aggs)
    args = ", ".join(f"'{f}', `{f}__m`, `{f}__s`" for f in features)
    return (wide.selectExpr(f"stack({len(features)}, {args}) AS (feature, mean, std)")
                .withColumn("max", F.col("mean") + F.col("std")))


def edges_frame(maxima: DataFrame) -> DataFrame:
    """(feature, edge_index, edge) for i = 0..98, with e_i = i * (max / 99)."""
    return (maxima.select("feature", "max", F.posexplode(
                F.transform(F.sequence(F.lit(0), F.lit(N_EDGES - 1)),
                            lambda i: i.cast("double") * (F.col("max") / F.lit(float(N_EDGES))))).alias("edge_index", "edge"))
                  .select("feature", F.col("edge_index").cast("int").alias("edge_index"), "edge"))


def _lit(v: float | None) -> str:
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def bucket_sql(col: str, max_value: float | None) -> str:
    """Spark SQL expression for the bucket of ``col`` given the fitted maximum."""
    s = f"({_lit(max_value)} / {float(N_EDGES)!r})"
    f = f"CAST({col} AS DOUBLE)"
    k0 = f"LEAST(98, CAST(FLOOR(GREATEST(0.0D, LEAST(99.0D, {f} / {s}))) AS INT))"
    k1 = (f"CASE WHEN {k0} < 98 AND ({k0} + 1) * {s} <= {f} THEN {k0} + 1 "
          f"WHEN {k0} >= 1 AND {k0} * {s} > {f} THEN {k0} - 1 ELSE {k0} END")
    return (f"CASE WHEN {s} IS NULL THEN NULL "
            f"WHEN {col} IS NULL OR isnan({f}) THEN {LAST_BUCKET} "
            f"WHEN {s} < 0 THEN CASE WHEN {f} < {s} THEN 0 ELSE {LAST_BUCKET} END "
            f"WHEN {s} = 0 THEN CASE WHEN {f} < 0 THEN 0 ELSE {LAST_BUCKET} END "
            f"WHEN ({k1}) >= 98 THEN {LAST_BUCKET} ELSE ({k1}) END")


def bucketize(df: DataFrame, maxima: dict[str, float | None], suffix: str = "") -> DataFrame:
    """Replace (or add, with ``suffix``) each feature in ``maxima`` by its bucket."""
    out = df
    for f, m in maxima.items():
        out = out.withColumn(f + suffix, F.expr(bucket_sql(f"`{f}`", m)).cast("int"))
    return out


def collect_maxima(table: DataFrame, features: list[str], population: str = "featured") -> dict[str, float | None]:
    """Fitted state: the per-feature maximum (a 1-row aggregate, a handful of numbers)."""
    rows = maxima_frame(table, features, population).select("feature", "max").collect()
    return {r["feature"]: r["max"] for r in rows}
