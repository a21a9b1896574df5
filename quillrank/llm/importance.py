"""Quality classifier by importance resampling (operator 5).

Two generative models over hashed word unigrams and bigrams are counted: one
of the target (documents labelled good) and one of the raw corpus (all
documents). A document's log weight is the sum over its n-grams of the log
ratio of the two, brought to the length of ``LENGTH`` n-grams so that it tells
of the kind of text and not of its size; a Gumbel number seeded by the document
is added and the top k documents are sampled, which draws k documents without
replacement in proportion to their weights. k is not given but estimated: the documents whose
weight passes the level that best parts the labelled good from the others
(a labelled document is weighed without its own counts).

The raw counts cover every word of every document. Target rows are at most
``TARGET_ROWS`` labelled rows (a broadcast of a known bound); each task sends
one count a bucket, so the driver gets ``BUCKETS`` rows. The k-th key comes
from radix selection by counts; nothing is sorted globally.

Defined results: a document without n-grams (null, empty) is rejected; without
any labelled target every other document is kept; equal id and text have the
same key; rows with null labels are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillrank.llm.common import col, in_slices, kth_largest, stored, texts, trimmed, written

BUCKETS = 1 << 14
#: Labelled rows that the target model and the level are learned from, at most.
TARGET_ROWS = 200_000
#: Weight of the raw model in the target's smoothing, in n-grams a bucket.
SMOOTHING = 1.0
#: N-grams of the text length that all weights are brought to.
LENGTH = 500
SEED = 5
#: Words whose hashes a task remembers.
CACHE = 150_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashed(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def buckets_of(text: str, hashed: Hashed, n: int = BUCKETS) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text, repeats included."""
    words = _TOKEN.findall(text.lower())
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * _MIX + h[1:]) * _MIX
    return (np.concatenate([h, pairs >> np.uint64(17)]) % np.uint64(n)).astype(np.int64)


def ngram_counts(docs: DataFrame, text_col: str, target: Column, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``raw`` and ``target`` counts of n-grams over all rows."""
    row = docs.select(col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashed = np.zeros((2, buckets), np.int64), Hashed()
        for batch in batches:
            for text, good in zip(in_slices(batch.column(0), texts), batch.column(1).to_pylist(), strict=True):
                of = np.bincount(buckets_of(text, hashed, buckets), minlength=buckets) if text else 0
                counts[0] += of
                if good:
                    counts[1] += of
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "raw", "target"])

    partial = row.mapInArrow(trimmed(run), "bucket long, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


@dataclass
class Models:
    """Bucket counts of the raw corpus and the target; the target is smoothed towards the raw model."""

    raw: np.ndarray
    target: np.ndarray
    smoothing: float = SMOOTHING

    def __post_init__(self):
        self.p = (self.raw + 1.0) / (self.raw.sum() + len(self.raw))
        self.ratios = self._ratios(self.target, int(self.target.sum()), slice(None))

    def _ratios(self, target: np.ndarray, total: int, at) -> np.ndarray:
        weight, p = self.smoothing * len(self.raw), self.p[at]
        return np.log((target + weight * p) / (total + weight)) - np.log(p)

    def log_weight(self, found: np.ndarray, learned: bool) -> float:
        """Log weight of a document's n-grams; one that the target was learned from is judged without its own counts."""
        if not learned:
            return float(self.ratios[found].sum())
        own, n = np.unique(found, return_counts=True)
        return float((n * self._ratios(self.target[own] - n, int(self.target.sum()) - len(found), own)).sum())


def gumbel(*seeds: Column) -> Column:
    """A standard Gumbel number from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(*seeds), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def best_level(weights: np.ndarray, good: np.ndarray) -> float | None:
    """The level that leaves most rows on their side, good above and others below; None if one kind is missing."""
    if not good.any() or good.all():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    below_good, below_bad = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(~g)])
    value = below_bad - below_good
    cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))  # between different weights only
    best = cuts[np.argmax(value[cuts])]
    if best == 0:
        return float("-inf")
    return float("inf") if best == len(w) else float((w[best - 1] + w[best]) / 2)


def _labelled(labels: DataFrame, id_col: str, quality_col: str, toxic_col: str, rows: int) -> DataFrame:
    """``id`` and ``good`` of at most ``rows`` labelled ids, chosen by hash."""
    good = (col(quality_col) == 1) & (F.coalesce(col(toxic_col), F.lit(0)) == 0)
    ids = labels.where(col(id_col).isNotNull() & col(quality_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.min(good).alias("good"), F.min(col(quality_col)).alias("quality"))
    return ids.orderBy(F.xxhash64("id"), "id").limit(rows)


def importance(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """For each row of ``docs``: struct ``doc`` of the ``carry`` columns, ``n_ngrams``, ``log_weight``, the ``weight`` at one length and the Gumbel ``key``."""
    known = F.broadcast(stored(_labelled(labels, id_col, quality_col, toxic_col, target_rows)))
    spark = docs.sparkSession
    texts_ = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(known, "id", "left")
    counts = np.zeros((2, buckets), np.int64)
    for bucket, raw, target in ngram_counts(texts_, "text", F.col("good"), buckets).collect():
        counts[:, bucket] = raw, target
    models = spark.sparkContext.broadcast(Models(counts[0], counts[1]))
    doc = F.struct(*[col(c).alias(c) for c in carry] or [F.lit(0)]).alias("doc")
    draw = gumbel(F.lit(seed), col(id_col), col(text_col).cast("string"))
    # A text that is carried is not sent to the worker a second time.
    inside = carry.index(text_col) if text_col in carry and docs.schema[text_col].dataType == StringType() else None
    text = col(text_col) if inside is None else F.lit(None)
    row = docs.select(doc, text.cast("string").alias("text"), draw.alias("gumbel"), col(id_col).alias("id"))
    row = row.join(known, "id", "left").select("doc", "text", "gumbel", "id", F.coalesce("good", F.lit(False)).alias("good"))
    schema = row.select("doc", "id", "gumbel", F.lit(0).cast("long").alias("n_ngrams"), F.lit(0.0).alias("log_weight")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            column = batch.column(1) if inside is None else batch.column(0).field(inside)
            n, weight = [], []
            for text, learned in zip(in_slices(column, texts), batch.column(4).to_pylist(), strict=True):
                found = buckets_of(text, hashed, buckets)
                n.append(len(found))
                weight.append(models.value.log_weight(found, learned))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], names=["doc", "id", "gumbel", "n_ngrams", "log_weight"])

    scored = row.mapInArrow(trimmed(run), schema)
    weight = F.when(F.col("n_ngrams") > 0, F.col("log_weight") / F.col("n_ngrams") * LENGTH).otherwise(F.lit(0.0))
    return scored.withColumn("weight", weight).select("doc", "id", "n_ngrams", "log_weight", "weight", (F.col("weight") + F.col("gumbel")).alias("key"))


def _fixed_point(key: Column) -> Column:
    """An order-keeping whole number."""
    return F.floor(key * float(1 << 20)).cast("long")


def selection(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", target_rows: int = TARGET_ROWS) -> tuple[int, int | None]:
    """k and the smallest fixed-point key of the top k of stored ``importance`` rows."""
    known = F.broadcast(_labelled(labels, id_col, quality_col, toxic_col, target_rows))
    usable = scored.where("n_ngrams > 0")
    # One weight an id: repeated ids do not weigh more, and the rows stay within the bound.
    seen = usable.join(known, "id").groupBy("id").agg(F.min("weight").alias("w"), F.min("quality").alias("quality")).collect()
    level = best_level(np.array([r["w"] for r in seen], float), np.array([r["quality"] == 1 for r in seen], bool))
    k = (usable if level is None else usable.where(F.col("weight") >= level)).count()
    return k, kth_largest(usable.select(_fixed_point(F.col("key")).alias("key")), "key", k)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_ngrams``, ``log_weight``, ``key`` and whether it is ``kept``."""
    scored = stored(importance(docs, labels, [], id_col, **options).drop("doc"))
    _, least = selection(scored, labels, id_col)
    kept = F.lit(False) if least is None else (F.col("n_ngrams") > 0) & (_fixed_point(F.col("key")) >= least)
    return scored.select(F.col("id").alias(id_col), "n_ngrams", "log_weight", "key", kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", **options) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps.

    Rows go with their keys to a table in the shared folder, which is filtered
    once the least key is known; they are not shuffled or joined again, and
    equal ids do not mix.
    """
    at = docs.columns.index
    names = [f"c{i}" for i in range(len(docs.columns))]  # names that cannot clash in a file
    known = labels.select(col(id_col).alias(names[at(id_col)]), col(quality_col).alias("quality"), col(toxic_col).alias("toxic"))
    scored = importance(docs.toDF(*names), known, names, names[at(id_col)], names[at(text_col)], **options)
    scored = written(scored, "importance")
    _, least = selection(scored, known, names[at(id_col)])
    if least is None:
        return docs.limit(0)
    kept = scored.where((F.col("n_ngrams") > 0) & (_fixed_point(F.col("key")) >= least))
    return kept.select(*[F.col("doc").getField(n).alias(name) for n, name in zip(names, docs.columns, strict=True)])
