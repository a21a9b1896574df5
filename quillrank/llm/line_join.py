"""Line dedup by an exact set-similarity join (operator 6).

A line is the set of its words (A-Z lower-cased, parted by ASCII white space).
Two lines are similar if the Jaccard likeness of their sets is ``THRESHOLD``
or more; of similar or equal lines only the earliest, by id and place, stays.

1. All lines are hashed as sets; equal sets are one line from here on (its
   earliest occurrence stands for it). The same pass counts words in a hashed
   table of fixed size.
2. Words of a line are ordered by rarity (the counts, to a power of two, then
   the word's hash: a total order). Similar lines share a word among the first
   n - ceil(t n) + 1 of them; each such word is an index entry.
3. Entries meet by word. Pairs pass the length, the positional and a bitmap
   filter (bits in which parity bitmaps of the words differ are a lower bound
   of the difference; long lines have wider ones). A task first pairs each line
   with the one least apart of a few lines before it in its words' lists (the
   first ones and the nearest), and goes on through all earlier lines of its
   lists only where none of these passes. So near copies, which are alike with
   any of their group, make a number of pairs that grows with the lines.
4. Pairs are verified on the whole sets. Of the lines that a task has stopped
   at a first pair, those that no pair removes are then paired with all
   earlier lines of their lists, which the task has kept packed, and verified,
   so no pair that could matter is left out.

Words that might be in very many prefixes (by their counts) are split: similar
lines share two words of a prefix one longer, so such a word is only met
together with a second one. Entries of copies are dropped in each task before
they are sent, as bytes, a row for each task. Lines of fewer than 4 words can
be similar to equal sets only.

Words are 40-bit hashes and sets 128-bit ones; texts are not compared.

Defined results: null and empty texts have no line; blank lines are kept and
not counted; ids that are null come last, and rows with equal ids are told
apart by their place in the scan (``docs`` should be a stored table).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillrank.llm.common import col, map_batches, trimmed, utf8_texts, written
from quillrank.llm.words import chunks, mix, word_hashes

THRESHOLD = 0.8
#: Hashed word counts, and the count from which a word is met together with a second one only.
COUNTS = 1 << 20
CROWDED = 50_000
#: Index entries of a task, and pairs filtered at a time.
TASK_ENTRIES = 200_000
PAIRS = 1 << 18
#: Entries that are dealt out to the tasks at a time, and bytes of texts read at a time.
DEALT = 300_000
CHUNK = 1 << 18
#: Lines at the head of a word's list, and right before a line in it, that the first round pairs a line with.
FIRST, NEAR = 4, 8
#: Words from which lines have bitmaps of 128 and of 256 bits: 64 tell long lines apart no more.
WIDE = 64, 128
#: Bits that tell which lines' words are asked for.
WANTED_BITS = 1 << 25
#: The hint of ids that are null.
LAST = (1 << 63) - 1
#: Columns of entries as tasks are sent them; the random ones are not compressed.
_ENTRY = {"n": "<i4", "at": "<i4", "hint": "<i8", "b1": "<u8", "b2": "<u8", "b3": "<u8", "key": "<i8", "h1": "<i8", "bits": "<u8"}
_RANDOM = ("key", "h1", "bits")
_COUNT_ROWS = 64
_TOKEN_BITS = 40


def _sorted_in_lines(line: np.ndarray, value: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits, sorted inside each line (lines ascend): packed behind their line, as many lines at a time as the other bits can tell apart."""
    out, room = np.empty(len(value), np.uint64), 1 << (64 - bits)
    for at in range(0, int(line[-1]) + 1 if len(line) else 0, room):
        low, high = np.searchsorted(line, [at, at + room])
        out[low:high] = np.sort(((line[low:high] - at).astype(np.uint64) << np.uint64(bits)) | value[low:high])
    return out & np.uint64((1 << bits) - 1)


def line_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line number and 40-bit hash of each word of UTF-8 bytes, distinct in a line and sorted by line and hash."""
    start, hashed = word_hashes(data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line = np.cumsum(data == 10, dtype=np.int64)[start]
    token = _sorted_in_lines(line, hashed >> np.uint64(64 - _TOKEN_BITS), _TOKEN_BITS)
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])])
    return line[new], token[new]


def set_hashes(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's set."""
    return tuple(np.add.reduceat(mix(token, salt), first).view(np.int64) for salt in (1, 2))


def line_chunks(documents: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: document and line in it of each line that has words, where its words begin, and the words."""
    for at, some in chunks(documents, CHUNK):
        lines = np.array([d.count(b"\n") + 1 for d in some])
        line, token = line_words(np.frombuffer(b"\n".join(some), np.uint8))
        if len(line):
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            number = line[first]
            owner = np.repeat(np.arange(len(some)), lines)[number]
            yield owner + at, number - (np.cumsum(lines) - lines)[owner], first, token


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("place"), col(text_col).cast("string").alias("text"))


def _lines_and_counts(placed: DataFrame) -> DataFrame:
    """Rows of lines (h1, h2, id, place, line), of documents (id, place and the ``numbers`` of their lines with words) and, with a ``part``, of word counts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = np.zeros(COUNTS, np.int64), None
        names = ["h1", "h2", "id", "place", "line", "numbers", "part", "counts"]
        for batch in batches:
            found, buckets = [(np.zeros(0, np.int64),) * 4], [np.zeros(0, np.int32)]
            for owner, line, first, token in line_chunks(utf8_texts(batch.column(2))):
                buckets.append((token & np.uint64(COUNTS - 1)).astype(np.int32))
                found.append((*set_hashes(token, first), owner, line))
            counts += np.bincount(np.concatenate(buckets), minlength=COUNTS)
            h1, h2, owner, line = (np.concatenate(c) for c in zip(*found, strict=True))
            take, rows = pa.array(owner), batch.num_rows
            none = [pa.nulls(len(owner), pa.int32()), pa.nulls(len(owner), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(take), batch.column(1).take(take), pa.array(line), pa.nulls(len(owner), pa.list_(pa.int64())), *none], names=names)
            numbers = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.array(line))
            none = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), batch.column(0), batch.column(1), pa.nulls(rows, pa.int64()), numbers, *none], names=names)
            ids = batch.column(0).type
        if ids is not None:
            parts = np.split(counts, _COUNT_ROWS)
            blank = pa.nulls(_COUNT_ROWS, pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, pa.nulls(_COUNT_ROWS, ids), blank, blank, pa.nulls(_COUNT_ROWS, pa.list_(pa.int64())), pa.array(range(_COUNT_ROWS), pa.int32()), pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts], pa.binary())], names=names)

    kind = placed.schema["id"].dataType.simpleString()
    return placed.mapInArrow(run, f"h1 long, h2 long, id {kind}, place long, line long, numbers array<long>, part int, counts binary")


def _rarity(rows: DataFrame) -> np.ndarray:
    """Logarithm of the hashed counts, a byte each: the table has a fixed size."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in group.counts)
        return pd.DataFrame({"part": [group.part.iloc[0]], "counts": [np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()]})

    found = rows.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    table = np.zeros((_COUNT_ROWS, COUNTS // _COUNT_ROWS), np.uint8)
    for part, counts in found:
        table[part] = np.frombuffer(counts, np.uint8)
    return table.ravel()


def _smallest_overlap(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def _bitmaps(token: np.ndarray, first: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Parity bitmaps of lines: 64 ``bits``; those of long lines are the folded form of 128 or 256, of which ``b1`` to ``b3`` are the second to last 64."""
    hashed = mix(token, 3)
    out = {"bits": np.bitwise_xor.reduceat(np.uint64(1) << (hashed & np.uint64(63)), first)} | {f"b{i}": np.zeros(len(first), np.uint64) for i in (1, 2, 3)}
    for low, high, parts in ((WIDE[0], WIDE[1], 2), (WIDE[1], np.inf, 4)):
        some = np.flatnonzero((n > low) & (n <= high))
        if len(some):
            size = n[some]
            begin = np.cumsum(size) - size
            at = hashed[np.repeat(first[some] - begin, size) + np.arange(int(size.sum()))]
            one, part = np.uint64(1) << (at & np.uint64(63)), (at >> np.uint64(6)) & np.uint64(parts - 1)
            for i in range(1, parts):
                out[f"b{i}"][some] = np.bitwise_xor.reduceat(np.where(part == i, one, np.uint64(0)), begin)
    return out


def prefix_entries(first: np.ndarray, token: np.ndarray, rarity: np.ndarray, crowded: int, t: float) -> dict[str, np.ndarray]:
    """Index entries of lines: key, line (here), its size, the position of the word, and the line's bitmap."""
    n = np.diff(np.concatenate([first, [len(token)]]))
    line = np.repeat(np.arange(len(first)), n)
    level = rarity[(token & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
    key = _sorted_in_lines(line, (level << np.uint64(_TOKEN_BITS)) | token, _TOKEN_BITS + 6)
    token, level = key & np.uint64((1 << _TOKEN_BITS) - 1), key >> np.uint64(_TOKEN_BITS)
    place = np.arange(len(key)) - np.repeat(first, n)
    bits = _bitmaps(token, first, n)
    prefix = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
    usable = (n >= math.ceil(t / (1 - t) - 1e-9))[line]
    inside = usable & (place < prefix[line])
    full = inside & (level > math.log2(crowded))
    plain = np.flatnonzero(inside & ~full)
    keys, at, where = [mix(token[plain], 4)], [plain], [place[plain]]
    # A crowded word: once with each other word of the prefix that is one longer.
    crowd = np.flatnonzero(full)
    for other in range(int(prefix[line[crowd]].max()) + 1 if len(crowd) else 0):
        mine = crowd[(other <= prefix[line[crowd]]) & (other < n[line[crowd]]) & (other != place[crowd])]
        second = token[first[line[mine]] + other]
        a, b = np.minimum(token[mine], second), np.maximum(token[mine], second)
        keys.append(mix(mix(a, 4) ^ b, 5))
        at.append(mine)
        where.append(np.minimum(place[mine], other))
    at, keys, where = np.concatenate(at), np.concatenate(keys), np.concatenate(where)
    of = line[at]
    return {"key": keys.view(np.int64), "line": of, "n": n[of], "at": where} | {c: b[of].view(np.int64) for c, b in bits.items()}


def _hint(id_col: Column, whole: bool) -> Column:
    """A number of the order of ids: what has a lower one comes first, of equal ones either may."""
    return F.coalesce(id_col.cast("long"), F.lit(LAST)) if whole else F.lit(0).cast("long")


def _dealt(found: dict[str, np.ndarray], tasks: int) -> pa.RecordBatch:
    """Entries by the task of their key: a row for each task, with the entries' columns as bytes."""
    task = found["key"] % tasks
    order = np.lexsort((found["key"], task))
    task = task[order]
    ends = np.append(np.flatnonzero(task[1:] != task[:-1]) + 1, len(task))
    found = {c: found[c][order].astype(kind) for c, kind in _ENTRY.items()}
    packer, blobs, at = zstandard.ZstdCompressor(level=1), [], 0
    for end in ends.tolist():
        small = packer.compress(b"".join(found[c][at:end].tobytes() for c in _ENTRY if c not in _RANDOM))
        blobs.append(len(small).to_bytes(4, "little") + small + b"".join(found[c][at:end].tobytes() for c in _RANDOM))
        at = end
    return pa.RecordBatch.from_arrays([pa.array(task[ends - 1]), pa.array(blobs, pa.binary())], names=["task", "entries"])


def _undealt(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The entries of some rows of ``_dealt``."""
    parts = {c: [] for c in _ENTRY}
    for blob in blobs:
        begin = 4 + int.from_bytes(blob[:4], "little")
        size = (len(blob) - begin) // sum(np.dtype(_ENTRY[c]).itemsize for c in _RANDOM)
        for raw, at, columns in ((zstandard.ZstdDecompressor().decompress(blob[4:begin]), 0, [c for c in _ENTRY if c not in _RANDOM]), (blob, begin, _RANDOM)):
            for c in columns:
                parts[c].append(np.frombuffer(raw, _ENTRY[c], size, at))
                at += size * np.dtype(_ENTRY[c]).itemsize
    return {c: np.concatenate(p) for c, p in parts.items()}


def _entries(placed: DataFrame, rarity, crowded: int, tasks: int, t: float) -> DataFrame:
    """Index entries of the lines, with a ``hint`` of their order, as rows of ``_dealt``."""
    whole = isinstance(placed.schema["id"].dataType, IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held, size = [], 0
        for batch in batches:
            hints = batch.column(1).to_numpy()
            for owner, _, first, token in line_chunks(utf8_texts(batch.column(0))):
                h1, _ = set_hashes(token, first)
                found = prefix_entries(first, token, rarity.value, crowded, t)
                new = np.zeros(len(first), bool)
                for i, (h, order) in enumerate(zip(h1.tolist(), hints[owner].tolist(), strict=True)):
                    # A copy is sent only if it comes before those sent already.
                    if seen.get(h, order + 1) > order:
                        new[i] = True
                        seen[h] = order
                if len(seen) > 1 << 19:
                    seen.clear()
                keep = np.flatnonzero(new[found["line"]])
                of = found.pop("line")[keep]
                held.append({c: v[keep] for c, v in found.items()} | {"h1": h1[of], "hint": hints[owner][of]})
                size += len(keep)
                if size >= DEALT:
                    yield _dealt({c: np.concatenate([h[c] for h in held]) for c in _ENTRY}, tasks)
                    held, size = [], 0
        if size:
            yield _dealt({c: np.concatenate([h[c] for h in held]) for c in _ENTRY}, tasks)

    return placed.select("text", _hint(F.col("id"), whole).alias("hint")).mapInArrow(trimmed(run), "task long, entries binary")


def passing(group: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of entries (of one key each) pass the length, positional and bitmap filters."""
    return _passing(group, a, b, t)[0]


def _passing(group: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs pass, and in how many words each differs at least, by the bitmaps."""
    n, at, bits = group["n"], group["at"], group["bits"]
    overlap = _smallest_overlap(n[a], n[b], t)
    ok = np.minimum(n[a], n[b]) >= overlap
    ok &= np.minimum(n[a] - at[a], n[b] - at[b]) >= overlap  # of the first shared word; all others stand behind it
    most = n[a] + n[b] - 2 * overlap
    apart = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64)
    ok &= apart <= most
    if "b1" in group:
        for low, parts in zip(WIDE, (_half_bitmap, _whole_bitmap), strict=True):
            some = np.flatnonzero(ok & (np.minimum(n[a], n[b]) > low))
            apart[some] = sum(np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(parts(group, a[some]), parts(group, b[some]), strict=True))
            ok[some] = apart[some] <= most[some]
    return ok, apart


def _half_bitmap(group: dict[str, np.ndarray], i: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of 128 bits; those of 256 are folded once."""
    second = group["b1"][i] ^ group["b3"][i]
    return [group["bits"][i] ^ second, second]


def _whole_bitmap(group: dict[str, np.ndarray], i: np.ndarray) -> list[np.ndarray]:
    b1, b2, b3 = (group[c][i] for c in ("b1", "b2", "b3"))
    return [group["bits"][i] ^ b1 ^ b2 ^ b3, b1, b2, b3]


def _near_pairs(group: dict[str, np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ``near_pairs``, and how far each is apart: the least difference by the bitmaps, in millionths of the words of both lines."""
    run, place, n = group["run"], group["place"], group["n"]
    order = np.lexsort((place, run))
    begin = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]]))
    start = np.repeat(begin, np.diff(np.append(begin, len(order))))
    seat = np.arange(len(order))
    late, early, apart = [], [], []
    for step in range(FIRST + NEAR):
        partner = start + step if step < FIRST else seat - (step - FIRST + 1)
        ok = np.flatnonzero((partner >= start) & (partner < seat))
        a, b = order[ok], order[partner[ok]]
        good, differ = _passing(group, a, b, t)
        a, b, differ = a[good], b[good], differ[good]
        late.append(a)
        early.append(b)
        apart.append(1_000_000 * differ // (n[a] + n[b]))
    late, early, apart = np.concatenate(late), np.concatenate(early), np.concatenate(apart)
    order = np.lexsort((apart, place[late]))
    one = order[_new(place[late][order])]
    return late[one], early[one], apart[one]


def near_pairs(group: dict[str, np.ndarray], t: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A passing pair (later and earlier entry) of each line that has one among the first and the nearest before it in its lists: the one least apart, as it is the likeliest to be similar."""
    return _near_pairs(group, t)[:2]


def open_pairs(group: dict[str, np.ndarray], asked: np.ndarray, t: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All passing pairs of the ``asked`` entries with earlier ones, or ones that no order is known to.

    Entries stand in the order of run and n, so those of fitting length are a
    stretch on either side, found by sorted search and taken in parts.
    """
    run, n, hint, place = group["run"], group["n"], group["hint"], group["place"]
    wide = 1 << 32
    order = run * wide + n
    low = np.searchsorted(order, run[asked] * wide + np.ceil(n[asked] * t - 1e-9).astype(np.int64))
    high = np.searchsorted(order, run[asked] * wide + np.floor(n[asked] / t + 1e-9).astype(np.int64), "right")
    while len(asked):
        room = np.minimum(high - low, max(1, PAIRS // len(asked)))
        for at in range(0, len(asked), PAIRS):
            counts = room[at : at + PAIRS]
            a = np.repeat(asked[at : at + PAIRS], counts)
            b = np.repeat(low[at : at + PAIRS] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            ok = (hint[b] <= hint[a]) & (place[a] != place[b])
            a, b = a[ok], b[ok]
            ok = passing(group, a, b, t)
            yield a[ok], b[ok]
        low = low + room
        left = low < high
        asked, low, high = asked[left], low[left], high[left]


_PACKED = {"run": "<i4", "n": "<i4", "at": "<i4", "place": "<i4", "bits": "<u8", "b1": "<u8", "b2": "<u8", "b3": "<u8"}


def _packed(group: dict[str, np.ndarray]) -> bytes:
    """Entries (all but the hints, which are those of their lines), compressed column by column."""
    steps = {c: np.diff(group[c], prepend=0) if c == "run" else group[c] for c in _PACKED if c in group}
    return len(group["run"]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(v.astype(_PACKED[c]).tobytes() for c, v in steps.items()))


def unpacked(data: bytes, hint: np.ndarray) -> dict[str, np.ndarray]:
    """The entries of ``_packed``, with the hints of their lines."""
    raw, size, at, out = zstandard.ZstdDecompressor().decompress(data[8:]), int.from_bytes(data[:8], "little"), 0, {}
    for c, kind in _PACKED.items():
        if at < len(raw) or not size:
            values = np.frombuffer(raw, kind, size, at)
            out[c] = values if kind == "<u8" else values.astype(np.int64)
            at += size * np.dtype(kind).itemsize
    out["run"] = np.cumsum(out["run"])
    out["hint"] = hint[out["place"]]
    return out


def _some(found: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in found.items()}


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before them."""
    differs = np.ones(len(columns[0]), bool)
    if len(differs):
        differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return differs


def _repeated(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places, in an order that sorts the keys, of keys that are there more than once."""
    begins = np.append(_new(key[order]), True)
    return order[~(begins[:-1] & begins[1:])]


def _candidates(entries: DataFrame, t: float) -> DataFrame:
    """``late`` and ``early`` ends of all pairs of some lines, ``near_late`` and ``near_early`` ends of the first pairs of others and how far they are apart, and packs of entries over ``lines`` (with their ``hint``) for the ``asked`` lines (places), which are put off."""

    columns = ["lines", "hint", "asked", "near_late", "near_early", "near_apart", "late", "early", "entries"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = _undealt(group.entries.tolist())
        # A word of one line joins nothing; of copies the earliest entry stands for all.
        found = _some(found, _repeated(found["key"], np.argsort(found["key"])))
        order = np.lexsort((found["hint"], found["h1"], found["key"]))
        found = _some(found, order[_new(found["key"][order], found["h1"][order])])
        found = _some(found, _repeated(found["key"], np.arange(len(found["key"]))))
        if not len(found["key"]):
            return pd.DataFrame({c: [] for c in columns})
        found = _some(found, np.lexsort((found["at"], found["n"], found["key"])))
        lines, of = np.unique(found.pop("h1"), return_inverse=True)
        hint = np.full(len(lines), LAST)
        np.minimum.at(hint, of, found["hint"])
        order = np.lexsort((lines, hint))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[of]
        lines, hint = lines[order], hint[order]
        key = found.pop("key")
        run_of = np.cumsum(_new(key)) - 1
        found |= {"run": run_of, "place": place, "hint": hint[place], "n": found["n"].astype(np.int64), "at": found["at"].astype(np.int64)}
        late, early, apart = _near_pairs(found, t)
        near, pairs = (lines[place[x]] for x in (late, early)), [np.zeros(0, np.int64)]
        is_put_off = np.zeros(len(lines), bool)
        is_put_off[place[late]] = True
        for a, b in open_pairs(found, np.flatnonzero(~is_put_off[place]), t):
            pairs.append(np.unique(place[a] << 32 | place[b]))
        code = np.unique(np.concatenate(pairs))
        # What lines that are put off may need: the lists that they are in.
        needed = np.zeros(int(run_of[-1]) + 1, bool)
        needed[run_of[is_put_off[place]]] = True
        keep = np.flatnonzero(needed[run_of])
        used, small = np.unique(place[keep], return_inverse=True)
        kept = {c: v[keep] for c, v in found.items() if c != "hint"} | {"place": small.ravel()}
        asked = np.flatnonzero(is_put_off[used])
        return pd.DataFrame([dict(zip(columns, (lines[used], hint[used], asked, *near, apart, lines[code >> 32], lines[code & 0xFFFFFFFF], _packed(kept)), strict=True))])

    return entries.groupBy("task").applyInPandas(run, ", ".join(f"{c} array<long>" for c in columns[:-1]) + ", entries binary")


def _open_pairs(packs: DataFrame, removed: DataFrame, t: float) -> DataFrame:
    """The pairs (a1, b1) of ``asked`` lines that are not ``removed`` (h1) yet with lines before them, or beside them in the order of hints."""
    asked = packs.select(F.explode(F.transform("asked", lambda at: F.get("lines", at.cast("int")))).alias("h1")).distinct()
    # Packs stay where they are: open lines are told by a table of bits, whose false hits cost time only.
    table = packs.sparkSession.sparkContext.broadcast(_bit_table(asked.join(removed.hint("merge"), "h1", "left_anti")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            lines, hint, put_off = (batch.column(c)[i].values.to_numpy() for c in (0, 1, 2))
            is_open = np.zeros(len(lines), bool)
            is_open[put_off] = _has_bit(table.value, lines[put_off])
            if not is_open.any():
                continue
            group = unpacked(batch.column(3)[i].as_py(), hint)
            for a, b in open_pairs(group, np.flatnonzero(is_open[group["place"]]), t):
                code = np.unique(group["place"][a] << 32 | group["place"][b])
                if len(code):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[code >> 32]), pa.array(lines[code & 0xFFFFFFFF])], names=["a1", "b1"])

    return map_batches(packs.select("lines", "hint", "asked", "entries"), "a1 long, b1 long", run).distinct()


def _bit_table(ends: DataFrame) -> np.ndarray:
    """Bits of the hashes ``h1``, in a table of fixed size: where it fills up, more lines than needed are sent."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) & np.uint64(WANTED_BITS - 1)] = True
        parts = np.split(np.packbits(bits), _COUNT_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_COUNT_ROWS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "bits"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(WANTED_BITS // 8 // _COUNT_ROWS, np.uint8)
        for bits in group.bits:
            total |= np.frombuffer(zlib.decompress(bits), np.uint8)
        return pd.DataFrame({"part": [group.part.iloc[0]], "bits": [zlib.compress(total.tobytes(), 1)]})

    table = np.zeros((_COUNT_ROWS, WANTED_BITS // 8 // _COUNT_ROWS), np.uint8)
    for part, bits in ends.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect():
        table[part] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return table.ravel()


def _has_bit(table: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a table of ``_bit_table``."""
    bit = h1.view(np.uint64) & np.uint64(WANTED_BITS - 1)
    return (table[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _line_sets(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """Lines (h1, h2) whose h1 is one of the ``ends``, with their ``first`` occurrence and their ``words``; texts stay where they are read, and lines that are not asked for (by a table of bits) are not sent."""
    whole = isinstance(placed.schema["id"].dataType, IntegralType)
    table = placed.sparkSession.sparkContext.broadcast(_bit_table(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            hints, found = batch.column(3).to_numpy(), []
            for owner, line, first, token in line_chunks(utf8_texts(batch.column(2))):
                h1, h2 = set_hashes(token, first)
                asked = np.flatnonzero(_has_bit(table.value, h1))
                new, known = [], []
                for i, h, order in zip(asked.tolist(), h1[asked].tolist(), hints[owner[asked]].tolist(), strict=True):
                    # Another occurrence is sent, without words, only if it may come before those sent already.
                    if h not in seen or order < seen[h] or order == LAST or not whole:
                        new.append(i)
                        known.append(h in seen)
                        seen[h] = order
                if len(seen) > 1 << 20:
                    seen.clear()
                if new:
                    new, known = np.array(new), np.array(known)
                    size = np.where(known, 0, np.diff(np.concatenate([first, [len(token)]]))[new])
                    ends = np.cumsum(size)
                    at = np.repeat(first[new] - (ends - size), size) + np.arange(int(ends[-1]))
                    found.append((h1[new], h2[new], owner[new], line[new], known, size, token[at].view(np.int64)))
            if found:
                h1, h2, owner, line, known, size, token = (np.concatenate(c) for c in zip(*found, strict=True))
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32(), mask=np.append(known, False)), pa.array(token))
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(take), batch.column(1).take(take), pa.array(line), words], names=["h1", "h2", "id", "place", "line", "words"])

    kind = placed.schema["id"].dataType.simpleString()
    read = placed.select("id", "place", "text", _hint(F.col("id"), whole).alias("hint"))
    found = read.mapInArrow(trimmed(run), f"h1 long, h2 long, id {kind}, place long, line long, words array<long>")
    return found.join(ends.hint("merge"), "h1", "left_semi").groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.first("words", ignorenulls=True).alias("words"))


def _order() -> Column:
    """What lines are ordered by."""
    return F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("place"), F.col("line"))


def _later_of_similar(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The later line (h1, and its first ``place`` and ``line``) of each pair (a1, b1) whose sets are similar."""
    a = sets.select(F.col("h1").alias("a1"), F.col("words").alias("a_words"), F.col("first").alias("a_first"))
    b = sets.select(F.col("h1").alias("b1"), F.col("words").alias("b_words"), F.col("first").alias("b_first"))
    shared = F.size(F.array_intersect("a_words", "b_words"))
    like = shared >= t * (F.size("a_words") + F.size("b_words") - shared) - 1e-9
    a_later = F.col("a_first") > F.col("b_first")
    # Merged at every size: words are too much to send to all tasks, and a plan that changes hides how it grows.
    later = pairs.join(a.hint("merge"), "a1").join(b.hint("merge"), "b1").where(like)
    later = later.select(F.when(a_later, F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(a_later, F.col("a_first")).otherwise(F.col("b_first")).alias("first"))
    return later.select("h1", "first.place", "first.line").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The lines (h1) that stand in ``pairs``."""
    return written(pairs.select(F.explode(F.array("a1", "b1")).alias("h1")).distinct(), "line-ends")


def _verified(placed: DataFrame, ends: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """The later lines (h1, place, line) of the ``pairs``, with these ``ends``, whose sets are similar."""
    return _later_of_similar(pairs, written(_line_sets(placed, ends), "line-sets"), t)


def later_lines(placed: DataFrame, rows: DataFrame, lines: DataFrame, t: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """``place`` and ``line`` of the first occurrences of lines that are similar to an earlier one."""
    rarity = placed.sparkSession.sparkContext.broadcast(_rarity(rows))
    # About 12 entries a line: a prefix is a fifth of a line's words.
    tasks = max(1, 12 * lines.count() // TASK_ENTRIES)
    packs = written(_candidates(_entries(placed, rarity, crowded, tasks, t), t), "line-packs")
    # Of a line that tasks have put off, the one of its first pairs that is least apart is enough here.
    near = packs.select(F.inline(F.arrays_zip(F.col("near_late").alias("a1"), F.col("near_early").alias("b1"), F.col("near_apart").alias("apart")))).groupBy("a1").agg(F.min_by("b1", "apart").alias("b1"))
    tops = near.union(packs.select(F.inline(F.arrays_zip(F.col("late").alias("a1"), F.col("early").alias("b1"))))).distinct()
    tops = written(tops, "line-tops")
    removed = written(_verified(placed, _ends(tops), tops, t), "line-removed")
    others = written(_open_pairs(packs, removed.select("h1"), t), "line-pairs")
    return removed.union(_verified(placed, _ends(others), others, t)).select("place", "line")


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """Each row's ``place``, ``id``, ``n_lines`` (with words) and the numbers of the ``removed`` ones."""
    placed = _placed(docs, id_col, text_col)
    rows = written(_lines_and_counts(placed), "lines")
    lines = rows.where("h1 is not null").select("h1", "h2", "id", "place", "line")
    first = lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first")).select("first.place", "first.line", F.lit(False).alias("later"))
    found = first.union(later_lines(placed, rows, lines, t, crowded).withColumn("later", F.lit(True)))
    by_row = found.groupBy("place").agg(*[F.collect_list(F.when(F.col("later") == later, F.col("line"))).alias(name) for name, later in (("firsts", False), ("laters", True))])
    joined = rows.where("numbers is not null").select("place", "id", "numbers").join(by_row, "place", "left")
    none = F.array().cast("array<long>")
    kept = F.array_except(F.coalesce("firsts", none), F.coalesce("laters", none))
    return joined.select("place", "id", F.size("numbers").cast("long").alias("n_lines"), F.sort_array(F.array_except("numbers", kept)).alias("removed"))


def remove_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """``docs`` without lines that are similar or equal to an earlier one."""
    doc = F.struct(*[col(c).alias(c) for c in docs.columns]).alias("doc")
    marks = mark_lines(docs, id_col, text_col, t, crowded).select("place", "removed")
    row = docs.select(doc, F.monotonically_increasing_id().alias("place")).join(marks, "place")
    lines = F.split(F.col("doc").getField(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    text = F.when(F.size("removed") > 0, left).otherwise(F.col("doc").getField(text_col))
    return row.select(*[(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
