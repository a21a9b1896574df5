"""Document fingerprints by Order MinHash (operator 8), in DataFrame functions only.

The k-mers (``K`` consecutive words) of a text are numbered by occurrence, so
that a repeated k-mer counts as often as it occurs. One hash of k-mer and
occurrence deals them to 2**``BIN_BITS`` bins and orders each bin (one-permutation
hashing in place of as many separate permutations). The ``TUPLE`` smallest of
a bin are put back into text order and hashed as a tuple: two texts agree in a
bin if they share its smallest k-mers in the same order, which edits and
reorderings both break.

Everything is worked out inside the row by higher-order functions: sorting
numbers that pack hash and position, cutting the sorted array into runs, and
slices of it, so that the work is n log n in the length of a text.

Defined results: a null or empty text has an empty fingerprint, alike (1.0) to
another empty one only; a text of fewer than ``K`` words is one k-mer; the
text's last document is followed by the first; rows with equal ids follow each
other by a hash of their texts, null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillrank.llm.common import col

K = 3
BIN_BITS = 6
TUPLE = 2
#: A number packs 6 bits for the bin, 32 for the order in it and 26 for the position of a k-mer.
POSITION_BITS = 26
HASH_BITS = 32
SIGNATURE_BITS = 16
#: Ranges of ids: at most so many, about so many rows each.
MAX_RANGES = 1000
RANGE_ROWS = 2000
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(size: Column) -> Column:
    """0 .. size-1."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _starts(numbers: Column, key: Callable[[Column], Column]) -> Column:
    """Where the runs of equal keys begin in an array."""
    return F.filter(_numbers(F.size(numbers)), lambda i: (i == 0) | (key(F.get(numbers, i)) != key(F.get(numbers, i - 1))))


def kmer_keys(text: Column, k: int = K) -> Column:
    """Hashes of the k-mers of a text in its order."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return let(
        words,
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def _run_start(s: Column, i: Column, steps: Column) -> Column:
    """Where the run of the key at ``i`` begins in sorted numbers, by binary search."""
    key = F.shiftright(F.get(s, i), POSITION_BITS)

    def halve(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["lo"] + range_["hi"], 1)
        below = F.shiftright(F.get(s, middle), POSITION_BITS) < key
        return F.struct(F.when(below, middle + 1).otherwise(range_["lo"]).alias("lo"), F.when(below, range_["hi"]).otherwise(middle).alias("hi"))

    # Once lo = hi, the middle is the start, which is not below: further steps change nothing.
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), i.alias("hi")), halve, lambda found: found["lo"])


def numbered(keys: Column) -> Column:
    """Sorted numbers that pack the hash of each k-mer with its occurrence number (above) and its position."""
    place = (1 << POSITION_BITS) - 1
    packed = F.sort_array(F.transform(keys, lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long"))))

    def deal(s: Column, steps: Column) -> Callable[[Column, Column], Column]:
        def element(x: Column, i: Column) -> Column:
            key = F.shiftright(x, POSITION_BITS)
            again = F.shiftright(F.get(s, i - 1), POSITION_BITS) == key
            occurrence = F.when(again, i - _run_start(s, i, steps)).otherwise(F.lit(0))
            return F.xxhash64(key, occurrence).bitwiseAND(F.lit(~place)).bitwiseOR(x.bitwiseAND(F.lit(place)))

        return element

    steps = lambda s: F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + F.lit(1))).cast("int"))
    return F.sort_array(let(packed, lambda s: let(steps(s), lambda n: F.transform(s, deal(s, n)))))


def signature(text: Column, k: int = K, size: int = TUPLE) -> Column:
    """The fingerprint as an array: for each bin that has k-mers, its number and the hash of its tuple."""
    low, bin_shift = (1 << HASH_BITS) - 1, 64 - BIN_BITS

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, bin_shift)

    def tuple_of(s: Column, start: Column) -> Column:
        least = F.filter(F.slice(s, start + 1, size), lambda x: bin_of(x) == bin_of(F.get(s, start)))
        in_order = F.sort_array(F.transform(least, _position_first))
        hashed = F.aggregate(in_order, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x.bitwiseAND(F.lit(low))))
        return F.shiftleft(bin_of(F.get(s, start)), SIGNATURE_BITS).bitwiseOR(hashed.bitwiseAND(F.lit((1 << SIGNATURE_BITS) - 1)))

    keys = kmer_keys(F.coalesce(text, F.lit("")), k)
    return let(numbered(keys), lambda s: let(_starts(s, bin_of), lambda starts: F.transform(starts, lambda at: tuple_of(s, at))))


def _position_first(x: Column) -> Column:
    """Position above hash, for sorting by text order."""
    place = x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    hashed = F.shiftrightunsigned(x, POSITION_BITS).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    return F.shiftleft(place, HASH_BITS).bitwiseOR(hashed)


def signature_text(value: Column) -> Column:
    """A fingerprint as a string: six hexadecimal digits a bin."""
    return F.array_join(F.transform(value, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of bins that agree, of those that either fingerprint has; 1 if both are empty."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, SIGNATURE_BITS)), F.transform(b, lambda x: F.shiftright(x, SIGNATURE_BITS))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / bins)


def with_next(docs: DataFrame, id_col: str, tie_col: str, carried: list[str], next_of: list[str], computed: dict[str, Column]) -> DataFrame:
    """Each row with ``next_<c>``, the column ``c`` of ``next_of`` in the row after it by ``id_col``; the first row follows the last.

    Rows are dealt to ranges of ids (bounds by approximate quantiles), and the
    first row of each range is also sent to the range before, so the order is
    found range by range without a global sort in one task. ``computed``
    columns are worked out once the rows are dealt, before the next is taken.
    """
    rows = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    pieces = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    found = docs.agg(F.percentile_approx(id_col, [i / pieces for i in range(1, pieces)], 10_000)).first()[0] if pieces > 1 else None
    bounds = sorted(set(found or []))
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= col(id_col))) if bounds else F.lit(0)
    ranged = docs.withColumn("_range", F.when(col(id_col).isNull(), F.lit(len(bounds))).otherwise(at))
    order = F.struct(col(id_col).isNull().alias("null"), col(id_col).alias("id"), col(tie_col).alias("tie"))
    firsts = sorted(((r["_range"], r["least"]) for r in ranged.groupBy("_range").agg(F.min(order).alias("least")).collect()), key=lambda r: r[0])
    guards = [(firsts[i - 1][0], least["id"], least["tie"]) for i, (_, least) in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    lead = docs.sparkSession.createDataFrame(guards, f"_to int, _id {kind}, _tie long")
    # At most MAX_RANGES + 1 rows: a broadcast of a known bound.
    extra = ranged.join(F.broadcast(lead), col(id_col).eqNullSafe(F.col("_id")) & (col(tie_col) == F.col("_tie")))
    extra = extra.withColumn("_range", F.col("_to")).select(*ranged.columns, F.lit(1).alias("_guard"))
    dealt = ranged.withColumn("_guard", F.lit(0)).unionByName(extra).repartition("_range").withColumns(computed)
    window = W.partitionBy("_range").orderBy("_guard", col(id_col).isNull(), id_col, tie_col)
    led = dealt.select(*carried, "_guard", *[F.lead(col(c)).over(window).alias(f"next_{c}") for c in next_of])
    return led.where("_guard = 0").drop("_guard")


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id``, ``n_chars``, ``text``, ``print`` (its fingerprint array) and the next row's ``next_text`` and ``next_print``."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    base = docs.select(col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    computed = {"n_chars": F.char_length("text").cast("long"), "print": signature(F.col("text"))}
    return with_next(base, "id", "tie", ["id", "n_chars", "text", "print"], ["text", "print"], computed)


def edited_text(text: Column, n_chars: Column, after: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the text after it."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - half).cast("int")), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and their edited texts, and how alike they are to those and to the next document's."""
    led = order_minhash(docs, id_col, text_col).withColumn("edited", edited_text(F.col("text"), F.col("n_chars"), F.col("next_text")))
    marked = led.withColumn("edited_print", signature(F.col("edited")))
    return marked.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        signature_text(F.col("print")).alias("fingerprint"),
        signature_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
