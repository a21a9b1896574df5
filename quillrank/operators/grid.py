"""Quality grid and suggestions.

The grid is the fixed lattice nLinks 0..495 step 5 × nWordsSummary 0..1395
step 5: exactly 28,000 points, so its size is bounded by construction and it
may be broadcast. Suggestions are, per page, the k grid points above the
score threshold nearest to the page's (nLinks, nWordsSummary), ties by
(n_links, n_words_summary). Pages are mapped in one pass, and every different
position of a batch is searched once: in each column of the lattice only the k
good points below and the k above the page can be among its nearest, so the
work hangs on the 100 columns and k, not on the number of good points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lattice ranges (start, stop exclusive, step).
N_LINKS_RANGE = (0, 500, 5)
N_WORDS_SUMMARY_RANGE = (0, 1400, 5)
GRID_POINTS = (N_LINKS_RANGE[1] // N_LINKS_RANGE[2]) * (N_WORDS_SUMMARY_RANGE[1] // N_WORDS_SUMMARY_RANGE[2])
THRESHOLD = 0.9
TOP_K = 5
_CHUNK = 1024  # positions per numpy block (1,024 × 100 columns × 2 k doubles)


def grid_points(spark: SparkSession) -> DataFrame:
    """(n_links, n_words_summary): the 28,000 lattice points from one Spark range."""
    a0, _, da = N_LINKS_RANGE
    b0, b1, db = N_WORDS_SUMMARY_RANGE
    nb = (b1 - b0) // db
    return spark.range(GRID_POINTS).select(
        (F.lit(a0) + F.floor(F.col("id") / nb) * da).cast("double").alias("n_links"),
        (F.lit(b0) + F.pmod(F.col("id"), F.lit(nb)) * db).cast("double").alias("n_words_summary"))


def grid_scores(grid: DataFrame, score_col) -> DataFrame:
    return grid.withColumn("grid_score", score_col)


def suggestions(pages: DataFrame, scored_grid: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD,
                exact_zero_mask: bool = False) -> DataFrame:
    """Per page (id, x, y) the k nearest grid points with score > threshold.

    ``exact_zero_mask`` also drops points with n_links = 0 (the original mask
    side effect); off by default.
    """
    spark = pages.sparkSession
    good = scored_grid.where(F.col("grid_score") > threshold)
    if exact_zero_mask:
        good = good.where(F.col("n_links") != 0)
    pts = good.select("n_links", "n_words_summary").toPandas()  # ≤ 28,000 rows by construction
    if len(pts) > GRID_POINTS:
        raise ValueError("grid larger than its fixed bound")
    columns = [(c, np.sort(g["n_words_summary"].to_numpy(np.float64))) for c, g in pts.astype(np.float64).groupby("n_links")]
    shared = spark.sparkContext.broadcast(columns)

    def search(batches):
        found = shared.value
        for pdf in batches:
            known = pdf[["x", "y"]].notna().all(axis=1).to_numpy()
            parts = [pd.DataFrame({"id": pdf["id"][~known], "rank": pd.array([None] * int((~known).sum()), "Int32"), **dict.fromkeys(("n_links", "n_words_summary", "distance"))})]
            pages = pdf[known]
            if len(pages) and found:
                places, of = np.unique(pages[["x", "y"]].to_numpy(np.float64), axis=0, return_inverse=True)
                blocks = [nearest(places[at : at + _CHUNK], found, k) for at in range(0, len(places), _CHUNK)]
                near = [np.concatenate(b) for b in zip(*blocks, strict=True)]
                size = near[0].shape[1]
                each = [a[of.ravel()].ravel() for a in near]
                parts.append(pd.DataFrame({"id": np.repeat(pages["id"].to_numpy(), size), "rank": pd.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(pages)), "Int32"),
                                           "n_links": each[1], "n_words_summary": each[2], "distance": each[0]}))
            for part in parts:
                if len(part):
                    yield part

    points = pages.select("id", F.col("x").cast("double"), F.col("y").cast("double"))
    kind = points.schema["id"].dataType.simpleString()
    return points.mapInPandas(search, f"id {kind}, rank int, n_links double, n_words_summary double, distance double")


def plain_suggestions(places: DataFrame, scored_grid: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(x, y, want): for each place the k nearest of all good points, each of which is looked at; what ``suggestions`` is checked against.

    A place without a coordinate has no distances: its k points are the first ones.
    """
    pts = scored_grid.where(F.col("grid_score") > threshold).select("n_links", "n_words_summary").toPandas().astype(np.float64)  # ≤ 28,000 rows by construction
    shared = places.sparkSession.sparkContext.broadcast(pts.sort_values(["n_links", "n_words_summary"]).to_numpy(np.float64))

    def search(batches):
        good = shared.value
        size = min(k, len(good))
        for pdf in batches:
            want = []
            for x, y in pdf[["x", "y"]].to_numpy(np.float64):
                far = np.sqrt(np.square(x - good[:, 0]) + np.square(y - good[:, 1]))
                if size and not np.isnan(far[0]):
                    # All that are no farther than the k-th, in order of distance; equal ones stay in order of their coordinates.
                    near = np.nonzero(far <= np.partition(far, size - 1)[size - 1])[0]
                    near = near[np.argsort(far[near], kind="stable")][:size]
                else:
                    near = np.arange(size)
                want.append([{"rank": i + 1, "n_links": a, "n_words_summary": b} for i, (a, b) in enumerate(good[near].tolist())])
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "want": want})

    points = places.select(F.col("x").cast("double"), F.col("y").cast("double"))
    return points.mapInPandas(search, "x double, y double, want array<struct<rank:int,n_links:double,n_words_summary:double>>")


def nearest(places: np.ndarray, columns: list[tuple[float, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, n_links and n_words_summary of the k nearest points of each place (all points, if they are fewer)."""
    far, x, y = [], [], []
    for column, heights in columns:
        # The points of a column stand in order: k on either side of the place hold its k nearest.
        at = np.searchsorted(heights, places[:, 1])[:, None] + np.arange(-k, k)
        inside = (at >= 0) & (at < len(heights))
        height = heights[np.clip(at, 0, len(heights) - 1)]
        far.append(np.where(inside, np.sqrt(np.square(places[:, :1] - column) + np.square(places[:, 1:] - height)), np.inf))
        x.append(np.full(at.shape, column))
        y.append(height)
    far, x, y = (np.concatenate(a, axis=1) for a in (far, x, y))
    size = min(k, sum(len(h) for _, h in columns))
    # All that are no farther than the k-th, then in order of distance, n_links, n_words_summary.
    kth = np.partition(far, size - 1, axis=1)[:, size - 1 : size]
    row, place = np.nonzero(far <= kth)
    order = np.lexsort((y[row, place], x[row, place], far[row, place], row))
    row, place = row[order], place[order]
    first = np.searchsorted(row, np.arange(len(far)))
    keep = (first[:, None] + np.arange(size)).ravel()
    row, place = row[keep], place[keep]
    return tuple(a[row, place].reshape(-1, size) for a in (far, x, y))
