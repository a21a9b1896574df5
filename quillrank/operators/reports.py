"""Report operators: population means (A1), bars and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report features with their outlier cut (grade_level < 20 in
# the means only).
MEAN_FEATURES = [
    ("reading_ease", None),
    ("grade_level", 20),
    ("nRefs", None),
    ("nLinks", None),
    ("nImages", None),
    ("nWordsSummary", None),
]


def feature_means(table: DataFrame, features=MEAN_FEATURES) -> DataFrame:
    """(feature, all_mean, featured_mean, flagged_mean) from ONE aggregation.

    The three populations overlap, so they are conditional averages of a
    single global aggregate (partial aggregation per task, one tiny final
    merge), then unpivoted with ``stack``.
    """
    wide = feature_means_wide(table, features)
    n = len(features)
    args = ", ".join(f"'{f}', `{f}__all`, `{f}__featured`, `{f}__flagged`" for f, _ in features)
    return wide.selectExpr(f"stack({n}, {args}) AS (feature, all_mean, featured_mean, flagged_mean)")


# Report features in report order with label and bar range.
REPORT_FEATURES = [
    ("grade_level", "Readability Grade Level", 5.0, 15.0),
    ("nLinks", "# Wikipedia links", 0.0, 500.0),
    ("nRefs", "# External Links", 0.0, 100.0),
    ("nWordsSummary", "# Words in Intro", 30.0, 500.0),
    ("nImages", "# Images", 0.0, 50.0),
]
READING_EASE_RANGE = ("reading_ease", "Reading Ease", 0.0, 100.0)
BAR_X1, BAR_X2, MARKER_WIDTH = 0.0, 350.0, 4.0


def display_score(score):
    """L1: 0..1 → 1..10 as int(round(9 s + 1)), halves rounded up."""
    return F.round(F.lit(9.0) * score + F.lit(1.0), 0).cast("int")


def _means_struct(table: DataFrame):
    """All report means as ONE scalar subquery (a struct), evaluated once."""
    wide = feature_means_wide(table)
    return wide.select(F.struct(*wide.columns).alias("m")).scalar()


def feature_means_wide(table: DataFrame, features=MEAN_FEATURES) -> DataFrame:
    aggs = []
    for feat, cut in features:
        x = F.col(feat).cast("double")
        ok = (F.col(feat) < cut) if cut is not None else F.lit(True)
        aggs += [F.avg(F.when(ok, x)).alias(f"{feat}__all"),
                 F.avg(F.when(ok & F.col("featured"), x)).alias(f"{feat}__featured"),
                 F.avg(F.when(ok & F.col("flagged"), x)).alias(f"{feat}__flagged")]
    return table.agg(*aggs)


def _unpivot_features(table: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., feature, label_name, xmin, xmax, value): one row per page and report feature."""
    n = len(REPORT_FEATURES)
    args = ", ".join(f"'{f}', '{lab}', CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE), CAST(`{f}` AS DOUBLE)"
                     for f, lab, lo, hi in REPORT_FEATURES)
    return table.selectExpr(*keep, f"stack({n}, {args}) AS (feature, label_name, xmin, xmax, value)")


def _mean_for(means, which: str):
    expr = None
    for f, _, _, _ in REPORT_FEATURES:
        v = means.getField(f"{f}__{which}")
        expr = F.when(F.col("feature") == f, v) if expr is None else expr.when(F.col("feature") == f, v)
    return expr


def bar_fractions(table: DataFrame, keep: list[str]) -> DataFrame:
    """L2: page value clamped to its range and scaled to 0..1, per report feature; a missing value has an empty bar."""
    u = _unpivot_features(table, keep)
    # least and greatest pass over nulls: a missing value stands at the low end.
    missing = F.col("value").isNull() | F.isnan("value")
    clamp = F.when(missing, F.col("xmin")).otherwise(F.greatest(F.least(F.col("value"), F.col("xmax")), F.col("xmin")))
    return u.withColumn("frac", (clamp - F.col("xmin")) / (F.col("xmax") - F.col("xmin")))


def mean_fractions(table: DataFrame) -> DataFrame:
    """L3: the three population means scaled to 0..1 (not clamped): one
    aggregate, unpivoted with ``stack``."""
    means = feature_means_wide(table)
    n = len(REPORT_FEATURES)
    rows = []
    for f, lab, lo, hi in REPORT_FEATURES:
        lo_s, w_s = f"CAST({lo!r} AS DOUBLE)", f"CAST({hi - lo!r} AS DOUBLE)"
        fr = [f"(`{f}__{w}` - {lo_s}) / {w_s}" for w in ("all", "featured", "flagged")]
        rows.append(f"'{f}', '{lab}', {', '.join(fr)}")
    return means.selectExpr(
        f"stack({n}, {', '.join(rows)}) AS (feature, label_name, all_frac, featured_frac, flagged_frac)")


def bar_label(label_name, value):
    """L4: '<name> = <value rounded>' for a page."""
    return F.concat(label_name, F.lit(" = "), F.round(value, 0).try_cast("long").cast("string"))


def page_report(table: DataFrame, keep: list[str]) -> DataFrame:
    """L5-L7 page mode: label with value, page bar end, featured-mean marker only."""
    means = _means_struct(table)
    b = bar_fractions(table, keep)
    featured = (_mean_for(means, "featured") - F.col("xmin")) / (F.col("xmax") - F.col("xmin"))
    w = F.lit(BAR_X2 - BAR_X1)
    return b.select(*keep, "feature", bar_label(F.col("label_name"), F.col("value")).alias("label"),
                    "value", "frac",
                    (F.lit(BAR_X1) + F.col("frac") * w).alias("x_page"),
                    (F.lit(BAR_X1) + featured * w).alias("x_featured_mean"))


def analytics_report(table: DataFrame) -> DataFrame:
    """L6/L7 averages mode: page bar at 0, markers for all three means."""
    m = mean_fractions(table)
    w = F.lit(BAR_X2 - BAR_X1)
    out = m.select("feature", F.col("label_name").alias("label"), F.lit(BAR_X1).alias("x_page"),
                   *[(F.lit(BAR_X1) + F.col(f"{k}_frac") * w).alias(f"x_{k}_mean") for k in ("all", "featured", "flagged")])
    return out.withColumn("x_featured_mean_end", F.col("x_featured_mean") + F.lit(MARKER_WIDTH))
