"""Benchmark decontamination (operator 1).

Each task indexes its documents in shards: an FM-index over the words of a
shard, in which all words that no benchmark item has are one separator, and
runs of benchmark words too short for any window are left out (a window can
occur only inside a longer run, so nothing is lost). Every window of the
benchmark is searched backwards through the wavelet-tree ranks; occurrences
are located by sampled suffix positions and merged into removal spans.

The benchmark is the query set. It is read in blocks of items of at most
``block_bytes`` of text; each block is broadcast and searched in one pass over
the documents, so what is broadcast has a fixed bound. Documents are never
shuffled: a hot source, group of copies or passage costs no more than its
share of the text.

Defined results: a null or empty text has no words and no spans; an item of
fewer words than a window is one window, an item of none is never found; an
empty benchmark marks nothing; repeated rows and null ids are kept as they
are; other columns are carried untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import WORD_PATTERN, col, plain_words, utf8_texts, trimmed
from quillrank.llm.fm_index import FMIndex

WINDOW = 10
#: Words of documents (after the short runs went) in one index.
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20


class Windows:
    """The windows of a block of benchmark items as symbol rows by length, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        self.shortest = min(map(len, found), default=0)
        self.by_length = []  # (length, rows of symbols, offsets into items, items)
        for length, group in itertools.groupby(sorted(found, key=len), key=len):
            rows = list(group)
            owners = [sorted(number[i] for i in found[r]) for r in rows]
            ends = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
            self.by_length.append((length, np.array(rows, np.int64), ends, np.array([i for o in owners for i in o], np.int64)))


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [lo, hi), and which range each is from."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which], which


def search_shard(windows: Windows, symbols: np.ndarray, document: np.ndarray, place: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
    """Merged (document, first word, end word) spans and (document, item) pairs of one shard.

    ``symbols`` ends each run with 0; ``document`` and ``place`` tell of each
    symbol the document and the number of the word there.
    """
    index = FMIndex(symbols, len(windows.vocabulary) + 1)
    change = np.zeros(len(symbols) + 1, np.int64)
    hits: list[np.ndarray] = []
    for length, rows, ends, owners in windows.by_length:
        lo, hi = index.search(rows)
        suffixes, which = expand(lo, hi)
        for start in range(0, len(suffixes), SHARD_WORDS):
            at, row = index.locate(suffixes[start : start + SHARD_WORDS]), which[start : start + SHARD_WORDS]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            pairs = np.unique(document[at] * len(rows) + row)
            owner, pair = expand(ends[pairs % len(rows)], ends[pairs % len(rows) + 1])
            hits.append(np.unique(pairs[pair] // len(rows) * len(windows.names) + owners[owner]))
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    first, end = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    spans = [(int(document[a]), int(place[a]), int(place[b - 1]) + 1) for a, b in zip(first, end, strict=True)]
    found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    return spans, [(int(x // len(windows.names)), windows.names[x % len(windows.names)]) for x in found]


def search_texts(windows: Windows, documents: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, merged spans of words and found items of each text, shard by shard."""
    counts, spans, items = [], [[] for _ in documents], [set() for _ in documents]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            symbols, document, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            found_spans, found_items = search_shard(windows, symbols, document, place)
            for d, a, b in found_spans:
                spans[d].append((a, b))
            for d, item in found_items:
                items[d].add(item)
            parts.clear()
            held = 0

    known = windows.vocabulary.get
    for number, text in enumerate(documents):
        words = plain_words(text)
        counts.append(len(words))
        if not windows.shortest or len(words) < windows.shortest:
            continue
        symbols = np.zeros(len(words) + 1, np.int64)
        symbols[:-1] = np.fromiter(map(known, words, itertools.repeat(0)), np.int64, len(words))
        inside = np.concatenate([[False], symbols != 0])
        first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        long = end - first >= windows.shortest
        if long.any():
            at, _ = expand(first[long], end[long] + 1)  # with the separator behind each run
            parts.append((symbols[at], np.full(len(at), number), at))
            held += len(at)
            if held >= SHARD_WORDS:
                flush()
    flush()
    return counts, spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the spans (and what stands between those words)."""
    words = [(m.start(), m.end()) for m in WORD_PATTERN.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join(out) + text[at:]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items of the benchmark in blocks of about ``block_bytes`` of text."""
    items = benchmark.where(col(text_col).isNotNull()).select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        inside = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r[0], r[1].encode("utf-8", "surrogatepass")) for r in inside.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """For each row of ``docs``: struct ``doc`` of the ``carry`` columns, ``n_words``, the merged word ``spans``
    and the sorted ``items`` that have occurring windows; with ``clean``, also ``text`` without the spans."""
    doc = F.struct(*[col(c).alias(c) for c in carry]) if carry else F.lit(0)
    row = docs.select(doc.alias("doc"), col(text_col).cast("string").alias("text"))
    row = row.select("doc", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    items, following = next(blocks, []), None
    while items is not None:
        following = next(blocks, None)
        windows = docs.sparkSession.sparkContext.broadcast(Windows(items, window))
        row = _search_block(row, windows, last=following is None, clean=clean)
        items = following
    return row


def _search_block(row: DataFrame, windows, last: bool, clean: bool) -> DataFrame:
    """Add the hits of one block of items; the last block cuts the spans or leaves the texts behind."""
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    schema = row.drop("text").schema if last and not clean else row.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            counts, spans, items = search_texts(windows.value, utf8_texts(named["text"]))
            spans = [merge_spans(new + [(x["first"], x["end"]) for x in old]) for new, old in zip(spans, named["spans"].to_pylist(), strict=True)]
            if last and not clean:
                del named["text"]
            elif last:
                whole = named["text"].to_pylist()
                named["text"] = pa.array([without_spans(t, s) if s else t for t, s in zip(whole, spans, strict=True)], pa.string())
            named["n_words"] = pa.array(counts, pa.int64())
            named["spans"] = pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], span_type)
            named["items"] = pa.array([sorted(new.union(old)) for new, old in zip(items, named["items"].to_pylist(), strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    return row.mapInArrow(trimmed(run), schema)


def hit_words() -> Column:
    """Words inside the merged spans of a row of ``find_leaks``."""
    return F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.first)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the benchmark's passages cut from the texts; a row that has no word left by this goes.

    Texts without a hit are returned as they are. A whole-number column
    ``n_chars`` of a cut text is set to the new length.
    """
    others = [c for c in docs.columns if c != text_col]
    found = find_leaks(docs, benchmark, others, text_col, **options, clean=True)
    hit = F.size("spans") > 0
    left = found.where(~hit | (hit_words() < F.col("n_words")))

    def field(name: str) -> Column:
        if name == text_col:
            return F.col("text").alias(name)
        old, kind = F.col("doc").getField(name), docs.schema[name].dataType
        if name == "n_chars" and kind.typeName() in ("long", "integer"):
            old = F.when(hit, F.char_length("text")).otherwise(old).cast(kind)
        return old.alias(name)

    return left.select(*[field(c) for c in docs.columns])
