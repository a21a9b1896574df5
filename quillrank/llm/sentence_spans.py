"""Substring dedup by sliding sentence spans (operator 4).

A text is cut into sentences: behind a word that ends in ``.``, ``!``, ``?`` or
a CJK full stop, and at line ends. Where ``WINDOW`` words in a row end no
sentence, it is also cut behind the one of the least hash (of equal ones the
last). A cut thus depends on the ``WINDOW - 1`` words on either side alone and
no piece is longer than ``WINDOW`` words, so that the same passage is cut at
the same places in all texts but near its ends, and ``PASSAGE`` common words
always hold a common span. Words are parted by white space; in scripts written
without blanks each code point is a word. From every sentence a span runs
over at least ``RUN`` sentences and ``RUN_WORDS`` words (white space and the
case of A-Z do not count). The 128-bit hashes of all spans are joined globally;
every occurrence but the first, by id and place, is repeated, and sentences
that such an occurrence covers are removed.

Hashes are counted by a partial aggregation, and only repeated ones are joined
back to their occurrences, so a passage of a third of all documents is one
counted key and a skewed equi-join that adaptive execution splits; no pairs are
formed. A table of bits of the repeated hashes tells which spans need not be
sent to that join (what it gets wrong costs time only). Spans are worked out again for the join: writing them out for both
uses would take more disk than the texts.

Defined results: a null or empty text has no sentence; a text shorter than a
span is kept; ids that are null come last; of rows with equal ids one counts as
the first (rows are told apart by their place in the scan, so ``docs`` should
be a stored table); other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import col, map_batches, stored, utf8_texts
from quillrank.llm.words import LOWER, chunks, mix, run_hashes, words

RUN = 3
RUN_WORDS = 16
#: Of so many words in a row one at least is cut behind.
WINDOW = 8
#: Bits (as a power of two) of the table of repeated hashes at most, and of a row of it.
MOST_BITS = 28
_PART_BITS = 15
#: Common words that surely hold a common span: up to the first sure cut, the longest span, and words whose cuts the host may change.
PASSAGE = 3 * WINDOW - 1 + max(RUN_WORDS - 1 + WINDOW, RUN * WINDOW)
_ENDS = np.array([b in b".!?" for b in range(256)])
#: The last code points of sentences in CJK text, and the scripts written without blanks (Thai and Lao, Tibetan, Burmese, Khmer, CJK with its kana, compatibility and wide forms, further ideographs).
_STOPS = np.array([ord(c) for c in "\u3002\uff01\uff0e\uff1f\uff61"])
_UNSPACED = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3130), (0x3190, 0xA000), (0xF900, 0xFB00), (0xFE30, 0xFE50), (0xFF00, 0xFFA0), (0x20000, 0x40000))
_LEADS = np.zeros(256, bool)
for _low, _high in _UNSPACED:
    _LEADS[chr(_low).encode()[0] : chr(_high - 1).encode()[0] + 1] = True


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the code points of scripts without blanks, and which of them end a sentence."""
    start = np.flatnonzero(_LEADS[data])
    size = np.where(data[start] >= 0xF0, 4, 3)
    whole = start + size <= len(data)
    start, size = start[whole], size[whole]
    if not len(start):
        return start, start, np.zeros(0, bool)
    code = (data[start].astype(np.int64) & np.where(size == 4, 7, 15)) << 12 | (data[start + 1] & np.int64(63)) << 6 | data[start + 2] & np.int64(63)
    code = np.where(size == 4, code << 6 | data[start + size - 1] & np.int64(63), code)
    alone = np.zeros(len(start), bool)
    for low, high in _UNSPACED:
        alone |= (code >= low) & (code < high)
    return start[alone], (start + size)[alone], np.isin(code[alone], _STOPS)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words, and which of them end a sentence."""
    start, end, hashed = words(data)
    at, behind, stop = _code_points(data)
    if not len(at):
        return start, end, hashed, _ENDS[data[end - 1]]
    # A blank-parted word is cut around its code points of such scripts; what is left between them stays a word.
    edges = np.unique(np.concatenate([start, end, at, behind]))
    inside = np.searchsorted(start, edges[:-1], "right") > np.searchsorted(end, edges[:-1], "right")
    start, end = edges[:-1][inside], edges[1:][inside]
    hashed = run_hashes(LOWER[data].astype(np.uint64) + np.uint64(1), start, end)
    last = _ENDS[data[end - 1]]
    last[np.searchsorted(start, at)] |= stop
    return start, end, hashed, last


def _cuts(hashed: np.ndarray, last: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words that end a sentence or are the last of least hash of ``WINDOW`` words of one text that end none."""
    n = len(hashed) - WINDOW + 1
    if n < 1:
        return last
    ends = np.concatenate([[0], np.cumsum(last)])
    begin = np.flatnonzero((ends[WINDOW:] == ends[:n]) & (of[WINDOW - 1 :] == of[:n]))
    least, at = hashed[begin], begin.copy()
    for i in range(1, WINDOW):
        other = hashed[begin + i]
        lower = other <= least
        least = np.where(lower, other, least)
        at[lower] = begin[lower] + i
    out = last.copy()
    out[at] = True
    return out


def _sentences(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by line ends: where each sentence ends among the words, the text it is of, and the ends (in bytes) and hashes of the words."""
    data = np.frombuffer(b"\n".join(documents), np.uint8)
    start, end, hashed, last = _words(data)
    if not len(end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), end, hashed
    line = np.cumsum(data == 10)[start]
    last |= np.append(line[1:] != line[:-1], True)
    owner = np.searchsorted(np.cumsum([len(d) + 1 for d in documents]), start, "right")
    stops = np.flatnonzero(_cuts(hashed, last, owner)) + 1
    return stops, owner[stops - 1], end, hashed


def _spans(stops: np.ndarray, owner: np.ndarray, run: int = RUN, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and end sentence of the spans: from each sentence on, the shortest run that is long enough."""
    starts = np.concatenate([[0], stops])  # words before each sentence, and all
    first = np.arange(len(stops))
    end = np.maximum(np.searchsorted(starts, starts[:-1] + run_words), first + run)
    limit = np.searchsorted(owner, owner, "right")  # sentences up to the end of the text
    fits = end <= limit
    return first[fits], end[fits]


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("place"), col(text_col).cast("string").alias("text"))


def _bit_table(homes: DataFrame) -> np.ndarray:
    """Bits of the hashes ``h1``, of bounded size: where it fills up, more spans than needed are sent."""
    bits = 1 << min(MOST_BITS, max(_PART_BITS, (16 * homes.count()).bit_length()))
    bit = homes.select(F.col("h1").bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct()

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        marked = np.zeros(1 << _PART_BITS, bool)
        marked[group.bit.to_numpy() & ((1 << _PART_BITS) - 1)] = True
        return pd.DataFrame({"part": [group.part.iloc[0]], "bits": [np.packbits(marked).tobytes()]})

    table = np.zeros((bits >> _PART_BITS, 1 << _PART_BITS - 3), np.uint8)
    for part, marked in bit.withColumn("part", F.shiftright("bit", _PART_BITS)).groupBy("part").applyInPandas(mark, "part long, bits binary").collect():
        table[part] = np.frombuffer(marked, np.uint8)
    return table.ravel()


def span_rows(placed: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """A row for each span of each text: 128-bit hash (h1, h2), ``id`` and ``place`` of the row, and ``span``: its first sentence (above 32 bits), its length, and (the lowest bit) whether the text has it before. With a table of ``wanted`` bits: of the spans it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(utf8_texts(batch.column(2))):
                stops, owner, _, hashed = _sentences(some)
                first, end = _spans(stops, owner)
                if not len(first):
                    continue
                starts = np.concatenate([[0], stops])
                h1 = run_hashes(hashed, starts[first], starts[end])
                h2 = run_hashes(mix(hashed, 1), starts[first], starts[end])
                of, begin = owner[first], np.searchsorted(owner, owner[first])
                order = np.lexsort((first, h1, of))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
                span = (first - begin) << 32 | (end - first) << 1 | again
                if wanted is not None:
                    bit = h1 & np.uint64(8 * len(wanted.value) - 1)
                    asked = np.flatnonzero(wanted.value[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1)
                    h1, h2, of, span = h1[asked], h2[asked], of[asked], span[asked]
                take = pa.array(of + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(span)],
                    names=["h1", "h2", "id", "place", "span"],
                )

    kind = placed.schema["id"].dataType.simpleString()
    return placed.mapInArrow(run, f"h1 long, h2 long, id {kind}, place long, span long")


def repeated_spans(placed: DataFrame) -> DataFrame:
    """``place``, first and end sentence of the span occurrences that are not the first of their hash."""
    # Rows with an id before rows without; the row's place goes along with the least id.
    named = span_rows(placed)
    with_id, without = F.col("id").isNotNull(), F.col("id").isNull()
    counted = named.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.min_by(F.when(with_id, F.col("place")), F.col("id")), F.min(F.when(without, F.col("place")))).alias("home"),
    )
    # Stored, so that the join reads both sides from a shuffle and its hot keys can be split.
    homes = stored(counted.where("n > 1").select("h1", "h2", "home"))
    wanted = placed.sparkSession.sparkContext.broadcast(_bit_table(homes))
    joined = span_rows(placed, wanted).select("h1", "h2", "place", "span").join(homes, ["h1", "h2"])
    again = F.col("span").bitwiseAND(F.lit(1)) == 1
    first, size = F.shiftright("span", 32), F.shiftright(F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    repeated = joined.where((F.col("place") != F.col("home")) | again)
    return repeated.select("place", first.cast("int").alias("first"), (first + size).cast("int").alias("end"))


def _covered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of runs: the number of the row, first and end of each run, as arrays (a list a row would be far larger)."""
    flat = column.flatten()
    lengths = column.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(column)), lengths), flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)


def _merged(n: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of texts of n sentences each, merged: a list for each text."""
    base = np.cumsum(n) - n
    change = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(change, base[row] + first, 1)
    np.add.at(change, base[row] + end, -1)
    covered = np.cumsum(change[:-1]) > 0
    opens = covered & ~np.concatenate([[False], covered[:-1]])
    shuts = covered & ~np.concatenate([covered[1:], [False]])
    heads = base[n > 0]  # a run ends with its text
    opens[heads] = covered[heads]
    shuts[heads[1:] - 1] = covered[heads[1:] - 1]
    begins, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    of = np.searchsorted(base[n > 0], begins, "right") - 1
    number = np.flatnonzero(n > 0)[of] if len(of) else of
    out: list[list[tuple[int, int]]] = [[] for _ in n]
    for i, a, b in zip(number.tolist(), (begins - base[number]).tolist(), (ends - base[number]).tolist(), strict=True):
        out[i].append((a, b))
    return out


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row as struct ``doc`` with ``n_sentences``, ``n_removed``, the merged ``removed`` runs of sentences and the ``text`` without them."""
    doc = F.struct(*[col(c).alias(c) for c in docs.columns if c != text_col] or [F.lit(0)]).alias("doc")
    runs = repeated_spans(_placed(docs, id_col, text_col)).groupBy("place").agg(F.collect_set(F.struct("first", "end")).alias("runs"))
    row = docs.select(doc, col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place")).join(runs, "place", "left").select("doc", "text", "runs")
    schema = row.select("doc", "text", F.lit(0).cast("long").alias("n_sentences"), F.lit(0).cast("long").alias("n_removed"), "runs").withColumnRenamed("runs", "removed").schema
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs_row, runs_first, runs_end = _covered(batch.column(2))
        for at, some in chunks(utf8_texts(batch.column(1))):
            stops, owner, end, _ = _sentences(some)
            n = np.bincount(owner, minlength=len(some))
            low, high = np.searchsorted(runs_row, [at, at + len(some)])
            removed = _merged(n, runs_row[low:high] - at, runs_first[low:high], runs_end[low:high])
            text = batch.column(1).slice(at, len(some))
            if any(removed):
                new, offset, base = text.to_pylist(), np.cumsum([0] + [len(d) + 1 for d in some]), np.cumsum(n) - n
                for i, whole in enumerate(some):
                    if removed[i]:
                        ends = end[stops[base[i] : base[i] + n[i]] - 1] - offset[i]
                        out, behind = [], 0
                        for a, b in removed[i]:
                            out.append(whole[behind : ends[a - 1] if a else 0])
                            behind = int(ends[b - 1])
                        new[i] = (b"".join(out) + whole[behind:]).decode("utf-8", "surrogatepass")
                text = pa.array(new, pa.string())
            n_removed = [sum(b - a for a, b in x) for x in removed]
            listed = pa.array([[{"first": a, "end": b} for a, b in x] for x in removed], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), text, pa.array(n.astype(np.int64)), pa.array(n_removed, pa.int64()), listed], names=["doc", "text", "n_sentences", "n_removed", "removed"])

    return map_batches(row, schema, run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated sentences cut from the texts."""
    out = with_repeats(docs, id_col, text_col)

    def field(name: str) -> Column:
        return (F.col("text") if name == text_col else F.col("doc").getField(name)).alias(name)

    return out.select(*[field(c) for c in docs.columns])
