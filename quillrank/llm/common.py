"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import scratch_path
from quillrank.sources.tables import materialize, read_table

#: Bytes that separate words in the contract's word pattern, and A-Z to lower case.
WORD_BYTES = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The same words in a text that has not been lower-cased, for spans in code points.
WORD_PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Base of the polynomial hashes of words inside byte arrays, and its inverse modulo 2^64.
HASH_BASE = np.uint64(0x9E3779B97F4A7C55)
HASH_INVERSE = np.uint64(pow(int(HASH_BASE), -1, 1 << 64))


def col(name: str) -> Column:
    """A column by its literal name (dots, blanks and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return read_table(spark, sf_dir, name, columns)


def utf8_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def in_slices(column: pa.Array, read: Callable[[pa.Array], list], rows: int = 256) -> Iterator:
    """The values that ``read`` (``texts`` or ``utf8_texts``) gives, so that few of a batch are held at a time."""
    for at in range(0, len(column), rows):
        yield from read(column.slice(at, rows))


def plain_words(text: bytes) -> list[bytes]:
    """Words of a text for matching against benchmarks: A-Z lowered, ASCII other than letters and digits separates."""
    return text.translate(WORD_BYTES).split()


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """The first n powers of a base modulo 2^64 (a table that grows in steps)."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        table = np.full(-(-max(n, 1) // (1 << 19)) << 19, base, np.uint64)
        table[0] = 1
        table = _POWERS[int(base)] = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which the worker, which later tasks use again, gives its free memory back."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None]) -> DataFrame:
    """Apply ``fn`` to each Arrow batch (Spark bounds a batch by rows and bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(trimmed(run), schema)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, which survives lost executors."""
    return materialize(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: like ``stored``, in Parquet's smaller form."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def probably_in(df: DataFrame, key: str, members: DataFrame, words: int = 1 << 18) -> DataFrame:
    """``df`` with a boolean ``_in``: false for rows whose long ``key`` is surely not a ``key`` of ``members``.

    A table of ``64 * words`` bits, one a hash, is broadcast: at most ``words``
    rows of 16 bytes whatever the size of ``members``. Where it fills up, more
    rows are true than need be, and none is false by mistake.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(64 * words))
    word = F.shiftright(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    marked = members.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = df.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(marked), "_word", "left")
    return out.withColumn("_in", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The exact k-th largest value of the long column ``key`` (None if k < 1 or there are fewer rows).

    Radix selection: four passes, each counting by the next 16 bits, so at
    most 65,536 counts come to the driver whatever the size of ``df``.
    """
    if k < 1:
        return None
    biased = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        inside = df if shift == 48 else df.where(F.shiftrightunsigned(biased, shift + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned(biased, shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(((r[0], r[1]) for r in inside.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if n >= left:
                prefix = (prefix << 16) | d
                break
            left -= n
        else:
            return None
    return (prefix ^ (1 << 63)) - (1 << 64 if (prefix ^ (1 << 63)) >= 1 << 63 else 0)
