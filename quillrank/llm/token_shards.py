"""Token-ID / binary output (operator 9).

Texts are encoded in ascending id order and written as shards. A shard is one
compressed binary file image: a wavelet matrix of its token ids (succinct
bit-planes with rank and select) and the ends of its documents, so that tokens
can be read by place, counted, and looked up by occurrence without decoding
the rest. Shards are rows of a Parquet folder in shared storage, written and
committed by Spark, so a lost executor's half-written files are never read.

Rows are dealt to tasks by ranges of ids and sorted there; no task or group
holds more than its range, and a range is cut into shards of about
``SHARD_TOKENS`` tokens. Where a document starts in the whole output comes
from the token totals of the ranges (one number a task on the driver).

Defined results: ids are those of the tokenizer's plain call, so the string of an
added token in a text is that token; a null or empty text is the end id alone; null ids come
first; rows with equal ids follow each other by a hash of their texts; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import HASH_BASE, HASH_INVERSE, col, powers, trimmed
from quillrank.llm.wavelet import WaveletMatrix
from quillrank.session import scratch_path

SHARD_TOKENS = 1 << 19
END_ID = 2
MAGIC = b"TKS1"
_HEADER = struct.Struct("<4sQQQQ")
#: Bytes of texts encoded at a time, and pieces whose ids a worker remembers.
GROUP_BYTES = 3 << 20
REMEMBERED = 600_000
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" for b in range(256)])
_RUN = re.compile(r"\s\s(?:\s|\Z)")
#: White space in UTF-8, and the bytes with which some of it begins or goes on.
_SPACE = np.array([chr(b).isspace() if b < 128 else b in b"\xc2\xe1\xe2\xe3" or b < 0xC0 for b in range(256)])


class _ByteAlphabet(dict):
    """The byte-level characters of each character, asked of the tokenizer once."""

    def __init__(self, tokenizer):
        self.pre_tokenizer = tokenizer.pre_tokenizer

    def __missing__(self, code: int) -> str:
        value = self[code] = "".join(x for x, _ in self.pre_tokenizer.pre_tokenize_str(chr(code)))
        return value


class Encoder:
    """The tokenizer's ids of texts, with the ids of pieces remembered.

    Byte-level BPE splits a text before a blank that follows a word, around a
    line end and behind a word's last letter, whatever stands there, so the
    pieces between those places can be encoded alone. It does look further in longer runs of white space;
    texts with such runs are encoded whole. So are texts that hold the string of an
    added token, unless ``added_as_text``: then that is ordinary text. The pieces of some texts are told
    apart by hashes (and compared byte by byte), so that the tokenizer and the
    memory are asked once for each different one. A word of letters, with the
    blank before it, is one unit of the merges and goes to them directly.
    """

    def __init__(self, path: str, group_bytes: int = GROUP_BYTES, remembered: int = REMEMBERED, added_as_text: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        added = [] if added_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.merger.encode_special_tokens = True
        self.merger.pre_tokenizer = WhitespaceSplit()  # for words that are byte-level characters already
        self.alphabet = _ByteAlphabet(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.pieces: dict[bytes, bytes] = {}
        self.group_bytes, self.remembered = group_bytes, remembered

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_words(self, pieces: list[bytes], words: list[str]) -> None:
        """Ids of words of letters: some hundred in one call, parted again by the bytes of their tokens."""
        for at in range(0, len(words), 500):
            plain = [w.replace(" ", "\u0120") if w.isascii() else w.translate(self.alphabet) for w in words[at : at + 500]]
            ids = np.array(self.merger.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            lengths = np.fromiter(map(len, plain), np.int64, len(plain))
            ends = (4 * (1 + np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths)))).tolist()
            data = ids.tobytes()
            self.pieces.update(zip(pieces[at : at + 500], [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of pieces that are not known yet."""
        decoded = [piece.decode("utf-8", "surrogatepass") for piece in new]
        is_word = [(t[1:] if t[:1] == " " else t).isalpha() for t in decoded]
        self._learn_words([p for p, w in zip(new, is_word, strict=True) if w], [t for t, w in zip(decoded, is_word, strict=True) if w])
        self.pieces.update((p, self._whole(t)) for p, t, w in zip(new, decoded, is_word, strict=True) if not w)

    def _pieces(self, data: np.ndarray, start_all: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the kept pieces of some bytes, one after the other, and how many each has."""
        end_all = np.append(start_all[1:], len(data))
        start, end = start_all[kept], end_all[kept]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), HASH_BASE), out=sums[1:])
        hashed = (sums[end] - sums[start]) * powers(len(data), HASH_INVERSE)[start]
        hashed ^= hashed >> np.uint64(31)
        order = np.argsort(hashed)
        new = np.concatenate([[True], hashed[order[1:]] != hashed[order[:-1]]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]  # a piece of each group
        whole = data.tobytes()
        keys = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        meant = whole if kept.all() else data[np.repeat(kept, end_all - start_all)].tobytes()
        if b"".join(map(keys.__getitem__, group.tolist())) != meant:  # two pieces of one hash
            keys = [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            group = np.arange(len(keys))
        unknown = [k for k in keys if k not in self.pieces]
        if len(self.pieces) + len(unknown) > self.remembered:  # forget, and learn what these texts need
            self.pieces.clear()
            unknown = keys
        self._learn(unknown)
        found = [self.pieces[k] for k in keys]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(sizes) - sizes
        return flat[_ranges(begin[group], sizes[group])], sizes[group]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time (null: empty): their ids, one after the other, and how many each has."""
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        everything = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.group_bytes)))
            end = min(end, len(column))
            yield self._encode_some(everything[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def _encode_some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        counts = np.zeros(n, np.int64)
        if not len(data):
            return np.zeros(0, "<u4"), counts
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        # A byte that may begin other white space counts as some here; the pattern decides.
        space = _SPACE[data]
        runs = np.flatnonzero(space[:-1] & space[1:])
        suspects = [i for i in np.unique(owner[runs]).tolist() if _RUN.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass"))]
        if self.added is not None:  # a match across two texts does no harm: whole texts are encoded alike
            held = [m.start() for m in self.added.finditer(data.tobytes())]
            suspects = sorted({*suspects, *owner[held].tolist()}) if held else suspects
        mark = (data == 32) | (data == 10)
        mark[1:] |= (data[:-1] == 10) | (_LETTER[data[:-1]] & _MARK[data[1:]])
        mark[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(mark)
        odd = np.zeros(n, bool)
        odd[suspects] = True
        plain = ~odd[owner[start]]
        ids, sizes = self._pieces(data, start, plain) if plain.any() else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        start = start[plain]
        counts += np.bincount(owner[start], sizes, n).astype(np.int64)
        if not suspects:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in suspects:
            parts[i] = np.frombuffer(self._whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")), "<u4")
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each range, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@functools.lru_cache(maxsize=1)
def encoder(path: str, group_bytes: int, remembered: int) -> Encoder:
    """One encoder a worker process, so that what it remembers outlives a task."""
    return Encoder(path, group_bytes, remembered, added_as_text=False)


class TokenShard:
    """One shard: its token ids as ranks in its alphabet, in a wavelet matrix, and where its documents end."""

    def __init__(self, tokens: WaveletMatrix, alphabet: np.ndarray, ends: np.ndarray):
        self.tokens, self.alphabet, self.ends = tokens, alphabet, ends

    @classmethod
    def of(cls, tokens: np.ndarray, lengths: np.ndarray) -> TokenShard:
        used = np.bincount(tokens) > 0
        rank = (np.cumsum(used) - 1).astype(np.uint16 if used.sum() <= 1 << 16 else np.uint32)
        alphabet = np.flatnonzero(used)
        return cls(WaveletMatrix.of(rank[tokens], max(1, int(len(alphabet) - 1).bit_length())), alphabet, np.cumsum(lengths, dtype=np.int64))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        ends, alphabet, planes = pack(np.diff(self.ends, prepend=0).astype("<u4").tobytes()), pack(self.alphabet.astype("<u4").tobytes()), self.tokens.to_bytes()
        return _HEADER.pack(MAGIC, len(self.ends), len(ends), len(self.alphabet), len(alphabet)) + ends + alphabet + planes

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenShard:
        magic, n, ends, symbols, alphabet = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")

        def part(at: int, size: int, count: int) -> np.ndarray:
            return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=4 * count or 1), "<u4")

        at = _HEADER.size
        return cls(WaveletMatrix.from_bytes(data[at + ends + alphabet :]), part(at + ends, alphabet, symbols), np.cumsum(part(at, ends, n), dtype=np.int64))

    def __len__(self) -> int:
        return len(self.ends)

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])

    def _rank(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def document(self, number: int) -> np.ndarray:
        """Token ids of one document, by access to its places only."""
        start = self.ends[number - 1] if number else 0
        return self.alphabet[self.tokens.access(np.arange(start, self.ends[number]))]

    def count(self, token: int) -> int:
        rank = self._rank(token)
        return 0 if rank is None else self.tokens.count(rank)

    def occurrences(self, token: int) -> list[tuple[int, int]]:
        """(document, place in it) of every occurrence of a token."""
        rank = self._rank(token)
        if rank is None:
            return []
        at = self.tokens.occurrences(rank)
        document = np.searchsorted(self.ends, at, "right")
        return list(zip(document.tolist(), (at - self.starts()[document]).tolist(), strict=True))

    def values(self) -> np.ndarray:
        """All token ids."""
        return self.alphabet[self.tokens.values()]

    def documents(self) -> list[np.ndarray]:
        return np.split(self.values(), self.ends[:-1])


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return row.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text", F.spark_partition_id().alias("part"))


def write_shards(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, group_bytes: int = GROUP_BYTES, remembered: int = REMEMBERED) -> None:
    """Write the shard folder ``path``: part, shard, start (in the part), n_tokens, doc ids and data of each shard."""
    row = _in_order(docs, id_col, text_col)
    kind = row.schema["id"].dataType
    schema = f"part int, shard int, start long, n_tokens long, ids array<{kind.simpleString()}>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, shard, part = encoder(tokenizer, group_bytes, remembered).encode, 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, start, shard
            tokens, lengths = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            data = TokenShard.of(tokens, lengths).to_bytes()
            ids = pa.concat_arrays([x[2] for x in held])
            column = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start]), pa.array([size]), column, pa.array([data], pa.binary())], names=["part", "shard", "start", "n_tokens", "ids", "data"])
            start, shard, size = start + size, shard + 1, 0
            held.clear()
            return out

        for batch in batches:
            part, at = batch.column(2)[0].as_py(), 0
            for tokens, counts in encode(batch.column(1)):
                ends = np.cumsum(counts)
                tokens = np.insert(tokens, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                begin = 0
                while begin < len(ends):  # whole documents until a shard is full
                    before = ends[begin - 1] if begin else 0
                    stop = min(len(ends), int(np.searchsorted(ends, before + shard_tokens - size)) + 1)
                    held.append((tokens[before : ends[stop - 1]], np.diff(ends[begin:stop], prepend=before), batch.column(0).slice(at + begin, stop - begin)))
                    size += int(ends[stop - 1] - before)
                    begin = stop
                    if size >= shard_tokens:
                        yield flush()
                at += len(counts)
        if held:
            yield flush()

    row.mapInArrow(trimmed(run), schema).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decode the shards: ``id_col``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document."""
    shards = spark.read.parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0), strict=False))
    shared = spark.sparkContext.broadcast(before)
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, ids, data = (batch.column(c)[i] for c in range(4))
                shard = TokenShard.from_bytes(data.as_py())
                first = shared.value[part.as_py()] + start.as_py()
                wide = shard.values().astype("<u4", copy=False)
                places = zip(shard.starts().tolist(), shard.ends.tolist(), strict=True)
                crc = [zlib.crc32(wide[a:b]) for a, b in places]
                lengths = np.diff(shard.ends, prepend=0)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(first + shard.starts()), pa.array(lengths), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "start", "ids", "data").mapInArrow(trimmed(run), f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as shards (to a fresh shared folder if no path is given) and read their documents back."""
    path = path or scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer, path, id_col, text_col, **options)
    return read_documents(docs.sparkSession, path, id_col)
