"""SimHash near-dedup (operator 3).

Fingerprints are compared by a self-join of binary tries: a node pair is
walked down together, its differing bits are added up, and it is dropped when
they exceed the budget. Spark deals the trie out: the bits that are still free
are cut into ``max_bits + 1`` parts, and two fingerprints within the budget
agree in one part at least, so every part gives subtrees (the fingerprints
that agree in it) which can be joined by themselves. A subtree with too many
fingerprints for a task is cut in the same way again, by its other bits.

Copies are one fingerprint from the start (partial aggregation), a subtree
gives at most one link a fingerprint (a spanning star of its components), so
nothing grows with the square of a group. Components of the links come from
rounds of joins in Spark; nothing is collected to the driver.

Defined results: a null or empty text has the fingerprint zero and is linked
like any other; a null id never names a component unless all its ids are null;
repeated rows are rows of the same component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import col, in_slices, map_batches, probably_in, stored, utf8_texts
from quillrank.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
#: Bytes that separate words here, and A-Z to lower case.
SPACE_BYTES = bytes(32 if b in b"\t\n\x0b\x0c\r " else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Fingerprints of the subtrees that a task joins at a time.
TASK_FINGERPRINTS = 100_000
#: Node pairs held at a time while walking a trie.
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits that are set in more than half of the shingles' XXH64 (seed 42)."""
    words = [w for w in text.translate(SPACE_BYTES).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(0, len(words) - shingle)]]
    digest, view = xxhash.xxh64_digest, memoryview(joined)
    hashes = b"".join([digest(view[a : b - 1], 42) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 19):  # big-endian digests: the first bit is the highest
        part = np.unpackbits(np.frombuffer(hashes, np.uint8, min(len(hashes) - at, 1 << 19), at)).reshape(-1, 64)
        counts += part.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Struct ``doc`` of the ``carry`` columns and the ``fingerprint`` (long) of each row's text."""
    row = docs.select(F.struct(*[col(c).alias(c) for c in carry]).alias("doc"), col(text_col).cast("string").alias("text"))
    schema = row.select("doc", F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in in_slices(batch.column(1), utf8_texts)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc", "fingerprint"])

    return map_batches(row, schema, run)


def hex_fingerprint(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def trie_pairs(keys: np.ndarray, values: np.ndarray, max_bits: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as indices) of equal key whose values differ in at most ``max_bits`` bits.

    ``values`` (distinct in a key) are sorted within each key, so that a trie
    node is a range of indices. All node pairs of a depth are split at once;
    when they are too many, half of them wait on a stack.
    """
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lo, hi = edges, np.concatenate([edges[1:], [len(keys)]])
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, lo1, hi1, lo2, hi2, used = stack.pop()
        if not len(lo1):
            continue
        if len(lo1) > frontier:
            half = len(lo1) // 2
            stack.append((bit, lo1[half:], hi1[half:], lo2[half:], hi2[half:], used[half:]))
            stack.append((bit, lo1[:half], hi1[:half], lo2[:half], hi2[:half], used[:half]))
            continue
        if bit < 0:  # leaves
            yield lo1, lo2
            continue
        ones = np.concatenate([[0], np.cumsum(values >> np.uint64(bit) & np.uint64(1), dtype=np.int64)]) if len(lo1) * 4 > len(values) else None
        mid1, mid2 = _split(values, bit, lo1, hi1, ones), _split(values, bit, lo2, hi2, ones)
        same = lo1 == lo2
        parts = [(lo1, mid1, lo2, mid2, used), (mid1, hi1, mid2, hi2, used)]
        more = used < max_bits
        parts.append((lo1[more], mid1[more], mid2[more], hi2[more], used[more] + np.int8(1)))
        more &= ~same
        parts.append((mid1[more], hi1[more], lo2[more], mid2[more], used[more] + np.int8(1)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3])
        keep &= (joined[0] != joined[2]) | (joined[1] - joined[0] > 1)  # a leaf with itself is no pair
        stack.append((bit - 1, *[x[keep] for x in joined]))


def _split(values: np.ndarray, bit: int, lo: np.ndarray, hi: np.ndarray, ones: np.ndarray | None) -> np.ndarray:
    """Where the ones of ``bit`` begin in each range (zeros come first there)."""
    if ones is not None:
        return hi - (ones[hi] - ones[lo])
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) // 2
        one = (values[np.minimum(mid, len(values) - 1)] >> np.uint64(bit) & np.uint64(1)) == 1
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)
    return a


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index linked to each of n indices."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            low, differ = np.minimum(ra, rb), ra != rb
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[differ], low[differ])
            while (root[root] != root).any():
                root = root[root]
    return root


def near_links(fingerprints: DataFrame, max_bits: int = MAX_BITS, task_fingerprints: int = TASK_FINGERPRINTS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fingerprint`` within ``max_bits`` bits."""
    rest, links = fingerprints.select("fingerprint", F.lit(0).cast("long").alias("fixed")), []
    while True:
        parts = stored(_cut(rest, max_bits))
        total = parts.count()
        tasks = max(1, -(-total // task_fingerprints))
        sizes = parts.groupBy("fixed", "value").count().where(F.col("count") > task_fingerprints)
        hot = sizes.select("fixed", "value")
        key = ["fixed", "value"]
        if hot.isEmpty():
            links.append(_join_subtrees(parts, tasks, max_bits))
            return _union(links)
        links.append(_join_subtrees(parts.join(hot, key, "left_anti"), tasks, max_bits))
        rest = parts.join(hot, key, "left_semi")


def _cut(df: DataFrame, max_bits: int) -> DataFrame:
    """Each fingerprint once for each part of the bits that are not ``fixed``; that part becomes fixed too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = batch.column(0).to_numpy().view(np.uint64)
        fixed = batch.column(1).to_numpy().view(np.uint64)
        out = []
        for mask in np.unique(fixed):
            mine = value[fixed == mask]
            free = [b for b in range(63, -1, -1) if not int(mask) >> b & 1]
            for part in np.array_split(np.array(free, np.uint64), max_bits + 1):
                wider = np.uint64(int(mask) | sum(1 << int(b) for b in part))
                out.append((mine, np.full(len(mine), wider, np.uint64), mine & wider))
        columns = [np.concatenate(x).view(np.int64) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fingerprint", "fixed", "value"])

    return map_batches(df.select("fingerprint", "fixed"), "fingerprint long, fixed long, value long", run)


def _join_subtrees(parts: DataFrame, tasks: int, max_bits: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(u=group.fingerprint.to_numpy().view(np.uint64)).sort_values(["fixed", "value", "u"])
        keys = group.groupby(["fixed", "value"], sort=False).ngroup().to_numpy()
        values = group.u.to_numpy()
        root = local_roots(len(values), trie_pairs(keys, values, max_bits))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": values[linked].view(np.int64), "b": values[root[linked]].view(np.int64)})

    dealt = parts.withColumn("task", F.pmod(F.xxhash64("fixed", "value"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(run, "a long, b long")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_components(prints: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``fingerprint`` and ``component_id``, the smallest ``id_col`` reachable, of each distinct fingerprint of ``prints``."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    linked = connected_components(near_links(distinct, max_bits))
    named = linked.join(distinct.withColumnRenamed("fingerprint", "node"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    near = linked.join(least, "component").select(F.col("node").alias("fingerprint"), "component", "component_id")
    out = distinct.join(near, "fingerprint", "left")
    return out.select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), F.coalesce("component_id", "least").alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fingerprint`` (hex) and ``component_id``."""
    prints = stored(with_fingerprints(docs, [id_col], text_col, shingle).select(F.col("doc").getField(id_col).alias("id"), "fingerprint"))
    components = near_components(prints, "id", max_bits)
    out = prints.join(components, "fingerprint")
    return out.select(F.col("id").alias(id_col), hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component left: that of its smallest id (null last; of rows that share it, one).

    Rows are told apart by their place in the scan, so ``docs`` should be a
    stored table or another plan that gives its rows in the same partitions
    when it is computed again.
    """
    place = "_simhash_place"
    while place in docs.columns:
        place += "_"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    prints = with_fingerprints(placed, [id_col, place], text_col, shingle)
    prints = stored(prints.select(F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(place).alias("place"), "fingerprint"))
    first = F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("place"))).alias("first")
    by_print = stored(prints.groupBy("fingerprint").agg(first))
    linked = connected_components(near_links(by_print, max_bits)).withColumnRenamed("node", "fingerprint")
    firsts = by_print.join(linked, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    kept = stored(firsts.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.place").alias("place")))
    # Most rows stay: a bounded table of bits of the dropped places tells which surely do, and only the others are shuffled.
    dropped = prints.select("place").join(kept, "place", "left_anti")
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    marked = probably_in(placed.select(row, col(place).alias("place")), "place", stored(dropped))
    out = marked.where(~F.col("_in")).select("row").unionByName(marked.where("_in").join(kept, "place", "left_semi").select("row"))
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
