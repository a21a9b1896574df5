"""Source divergence audit (operator 12).

How far the sources of each language differ in their words: for each group (a
language's source) its distance to every other source of the language, and
the terms that are most typical of it against the whole language. All numbers
are whole and exact (see ``probability`` and ``divergence``).

Terms of a group are found through a dominance skyband. A term's value grows
with its count in the group and falls with its count in the language, so a
term that ``k`` others dominate (count in the group at least as high, in the
language at most as high, UTF-8 earlier) cannot be among the first ``k``. Each
task keeps, for every group, the terms dominated by fewer than ``k`` others;
the tasks' skybands are merged in the same way, and what remains is ranked
exactly. A task holds ``BUFFERED`` rows; it passes its skybands on and begins
anew where they outgrow that, which only leaves more rows to rank.

Counts are combined in the tasks that read the texts, then in one shuffle by
language and term. Distances are summed over blocks of about ``BLOCK_TERMS``
kept terms and tiles of ``TILE`` sources; a block gives one sum for each pair
of sources, so neither a common term nor a large language gathers in a task.

Defined results: null text, language and source are read as ''; a group
without kept terms has its pairs and no terms; a language without kept terms
has value 0 in all pairs; a language of one source has no pairs; repeated rows
count as documents of their own; an empty table gives no rows. Exact up to
9 * 10^15 occurrences in a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import col, stored, utf8_texts, written

#: Documents of its language that a kept term is in, at least; terms reported a group.
LEAST_DOCUMENTS = 10
TOP = 10
#: Scale of the smoothed shares (fixed by the definition).
SCALE = 1_000_000_000
#: Different terms that a counting task holds, and rows that a skyband task holds.
COUNTED = 200_000
BUFFERED = 200_000
BLOCK_TERMS = 2_000
TILE = 256
#: Letters and all beyond ASCII make terms; A-Z are lowered.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), by long division in steps of 1000."""
    value, rest = F.lit(1).cast("long"), count + 2
    factor = SCALE
    for step in (None, 1000, 1000, 1000):
        if step:
            rest, factor = rest * step, factor // step
        value = value + F.call_function("div", rest, total) * factor
        rest = rest % total
    return value


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _probabilities(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    value, rest, factor = np.ones(np.broadcast(count, total).shape, np.int64), count + 2, SCALE
    for step in (1, 1000, 1000, 1000):
        rest, factor = rest * step, factor // step
        value += rest // total * factor
        rest = rest % total
    return value


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` of terms, in part sums."""
    rows = docs.select(_key(lang_col, "lang"), _key(source_col, "source"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in counts.items():
                if n:
                    size = len(n)
                    words = pa.array(list(n), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), words, pa.array(n.values(), pa.int64()), pa.array([documents[w] for w in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_texts(batch.column(2)), strict=True):
                words = terms_of(text)
                n, documents = counts.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                documents.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > COUNTED:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _key(name: str, alias: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit("")).alias(alias)


def kept_cells(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, **columns: str) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``lang_n`` of the kept terms; ``leads`` marks one row of each term of a language."""
    # One shuffle: the sums, and the window behind them, keep to the placement by language and term.
    sums = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    rows = sums.select("*", F.sum("docs").over(whole).alias("lang_docs"), F.sum("n").over(whole).alias("lang_n"), F.min("source").over(whole).alias("first"))
    return rows.where(F.col("lang_docs") >= least_documents).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).alias("leads"))


def group_totals(docs: DataFrame, cells: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every group: ``place`` among its language's sources, ``total`` (N + 2V) of it and ``lang_total``, ``v`` kept terms."""
    groups = docs.select(_key(lang_col, "lang"), _key(source_col, "source")).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("leads"))
    joined = groups.join(sums, ["lang", "source"], "left")
    whole = Window.partitionBy("lang")
    n, leads = F.coalesce("n", F.lit(0)), F.coalesce("leads", F.lit(0))
    rows = joined.select("lang", "source", n.alias("n"), F.sum(n).over(whole).alias("lang_n"), F.sum(leads).over(whole).alias("v"), F.row_number().over(whole.orderBy("source")).alias("place"))
    return rows.select("lang", "source", F.col("place") - 1, (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"), "v").toDF("lang", "source", "place", "total", "lang_total", "v")


def skyband(n: np.ndarray, lang_n: np.ndarray, terms: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate.

    In the order of falling ``n``, then ``lang_n``, then term, a row comes
    behind all that dominate it. It is enough to count among the rows kept so
    far: the first ``k`` that dominate a row are dominated by fewer than ``k``.
    """
    if len(n) <= k:
        return np.arange(len(n))
    rank = np.unique(terms, return_inverse=True)[1].ravel()
    order = np.lexsort((rank, lang_n, -n))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), chunk):
        some = order[at : at + chunk]
        before = np.concatenate([kept, some])
        dominates = (lang_n[before][:, None] <= lang_n[some]) & (rank[before][:, None] < rank[some])
        dominates[len(kept) :] &= np.tri(len(some), dtype=bool).T  # of these rows, only those before
        kept = np.concatenate([kept, some[dominates.sum(0) < k]])
    return kept


def skybands(rows: DataFrame, k: int = TOP, buffered: int | None = None) -> DataFrame:
    """Of each partition and group, at least the rows (lang, source, term, n, lang_n, value) that fewer than ``k`` others dominate."""
    limit = buffered or BUFFERED

    def reduce(frames: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(frames, ignore_index=True)
        places = [at[skyband(*(whole[c].to_numpy()[at] for c in ("n", "lang_n", "term")), k)] for at in whole.groupby(["lang", "source"], sort=False).indices.values()]
        return whole.iloc[np.concatenate(places)] if places else whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > limit:
                held = [reduce(held)]
                size = len(held[0])
                if 2 * size > limit:  # many groups: pass their skybands on
                    yield held.pop()
                    size = 0
        if held:
            yield reduce(held)

    return rows.select("lang", "source", "term", "n", "lang_n", "value").mapInPandas(run, "lang string, source string, term string, n long, lang_n long, value long")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def typical_terms(cells: DataFrame, totals: DataFrame, top: int = TOP, buffered: int | None = None) -> DataFrame:
    """The first ``top`` terms of each group that are commoner in it than in its language."""
    p, q = probability(F.col("n"), F.col("total")), probability(F.col("lang_n"), F.col("lang_total"))
    rows = cells.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", p.alias("p"), q.alias("q"))
    rows = rows.where("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    merged = skybands(skybands(rows, top, buffered).repartition("lang", "source"), top, buffered)
    return _ranked(merged.withColumnRenamed("term", "item"), "term").where(F.col("rank") <= top)


def source_pairs(cells: DataFrame, totals: DataFrame, block_terms: int | None = None, tile: int | None = None) -> DataFrame:
    """The distance of each group to every other source of its language."""
    block_terms, tile = block_terms or BLOCK_TERMS, tile or TILE
    placed = totals.select("lang", "source", "place", "total", F.floor(F.col("place") / tile).cast("int").alias("tile"), "v", F.ceil(F.greatest("v", F.lit(1)) / block_terms).cast("long").alias("blocks"))
    tiles = F.floor((F.max("place").over(Window.partitionBy("lang"))) / tile).cast("int")
    placed = placed.select("*", tiles.alias("last"))
    # A tile meets itself, those before it (as the later one) and those behind it.
    meets = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    keys = ["lang", "block", "i", "j"]
    in_block = cells.join(placed, ["lang", "source"]).select("lang", "place", "term", "n", F.pmod(F.xxhash64("term"), "blocks").alias("block"), F.inline(meets))
    in_all = placed.select("lang", "place", "total", "tile", "blocks", F.inline(meets))
    in_all = in_all.select("lang", "place", "total", "tile", "i", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    in_all = in_all.toDF("of_lang", "of_place", "of_total", "of_tile", "of_i", "of_j", "of_block")  # both sides come from ``placed``

    def sums(key: tuple, found: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        sources = sources.sort_values("of_place")
        place, total, of_tile = (sources[c].to_numpy() for c in ("of_place", "of_total", "of_tile"))
        terms, row = np.unique(found["term"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(terms), len(place)), np.int64)
        counts[row.ravel(), np.searchsorted(place, found["place"].to_numpy())] = found["n"].to_numpy()
        p = _probabilities(counts, total) if len(terms) else counts
        out = []
        for a in np.flatnonzero(of_tile == i):
            others = np.flatnonzero((of_tile == j) & (place > place[a]))
            one, many = p[:, a : a + 1], p[:, others]
            value = ((one - many) ** 2 // (one + many)).sum(0) if len(terms) else np.zeros(len(others), np.int64)
            out.append(pd.DataFrame({"lang": lang, "a": place[a], "b": place[others], "value": value, "terms": len(terms)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": [], "terms": []})

    parts = in_block.groupBy(*keys).cogroup(in_all.groupBy("of_lang", "of_block", "of_i", "of_j")).applyInPandas(sums, "lang string, a int, b int, value long, terms long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    both = pairs.select("lang", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), "value", "terms")
    least = probability(F.lit(0).cast("long"), F.greatest("total", F.lit(1)))  # the share of a term that a source lacks
    names = placed.select("lang", F.col("place").alias("a"), "source", least.alias("p"), "v")
    items = placed.select("lang", F.col("place").alias("b"), F.col("source").alias("item"), least.alias("q"))
    # Kept terms that no source of the two tiles has.
    lacking = (F.col("v") - F.col("terms")) * divergence(F.col("p"), F.col("q"))
    return _ranked(both.join(names, ["lang", "a"]).join(items, ["lang", "b"]).withColumn("value", F.col("value") + lacking), "pair")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank`` of all groups."""
    cells = written(kept_cells(docs, least_documents, text_col=text_col, lang_col=lang_col, source_col=source_col), "divergence-cells")
    totals = stored(group_totals(docs, cells, lang_col, source_col))
    return source_pairs(cells, totals).unionByName(typical_terms(cells, totals, top))
