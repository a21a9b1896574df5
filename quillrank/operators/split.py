"""Train/test split (M4) and standardisation (M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOD = 2147483648  # 2^31
_MUL = 1103515245
_ADD = 12345


def split_bucket(key: Column, seed: int = 0) -> Column:
    """A 0..9 bucket from an integer key: a multiplicative hash, top bits.

    Pure integer arithmetic (no overflow for any long key), so it is
    reproducible under any partitioning and in any SQL engine.
    """
    h = F.pmod(F.pmod(key.cast("long"), F.lit(_MOD)) * F.lit(_MUL) + F.lit(_ADD + int(seed)), F.lit(_MOD))
    return F.shiftright(h * F.lit(10), 31).cast("int")


def split_sql(key: str, seed: int = 0) -> str:
    return f"CAST(((((({key} % {_MOD}) + {_MOD}) % {_MOD}) * {_MUL} + {_ADD + int(seed)}) % {_MOD} * 10) >> 31 AS INTEGER)"


def add_split(df: DataFrame, key: str = "pageId", test_share: float = 0.4, seed: int = 0) -> DataFrame:
    """Adds ``is_train``: the lowest (1 - test_share) of the ten hash buckets train."""
    cut = int(round((1.0 - test_share) * 10))
    return df.withColumn("is_train", split_bucket(F.col(key), seed) < cut)


def standardize(df: DataFrame, features: list[str], where: Column | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std, statistics from the ``where`` rows.

    The statistics are one aggregate evaluated as scalar subqueries (no join);
    a zero std gives 0.0 like the usual scaler.
    """
    src = df.where(where) if where is not None else df
    stats = src.agg(*[F.avg(F.col(f).cast("double")).alias(f"{f}__m") for f in features],
                    *[F.stddev_pop(F.col(f).cast("double")).alias(f"{f}__s") for f in features])
    out = df
    for f in features:
        m = stats.select(f"{f}__m").scalar()
        s = stats.select(f"{f}__s").scalar()
        out = out.withColumn(f + suffix, F.when(s > 0, (F.col(f).cast("double") - m) / s).otherwise(F.lit(0.0)))
    return out
