"""SentencePiece encoding and decoding (operator 11).

Merge-type (BPE) models, encoded exactly by backtracking: the tokens of a text
are tried from left to right, the longest piece that an Aho-Corasick automaton
finds at a place first, then its shorter prefixes. A token is accepted if it
and the one before it are compatible, that is, if merging the text of both
from its characters gives back these two; a row of tokens of which all
neighbours are compatible is the one that merging the whole text gives. Where
no token fits, the place is marked as failed in a bitfield and the token
before it is given up, so every place fails at most once.

Two neighbours are re-merged along their common edge only: their last merges
are undone, the later one first, and a pair that meets there and makes a piece
of a better rank would have been merged instead. This holds where each piece
ranks behind the pieces it is made of; other pieces (runs of blanks of one
rank) are re-merged in full.

A text is cut before each blank that follows something else, if no piece of
the model holds such a place, and the ids of a worker's recent units are
remembered. The model file is read by the driver and broadcast (its size is
checked); texts are mapped without a shuffle, a slice at a time.

Defined results: a null or empty text has the end id alone and decodes to the
empty text; characters outside the vocabulary become byte pieces; rows are
mapped one by one, so repeated rows, ties and null ids need no rule; an empty
table gives no rows. Models of another kind than merges with byte pieces, or
with a normalizer that rewrites characters, raise ValueError.
"""

from __future__ import annotations

import codecs
import functools
import math
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import col, texts

#: The character that stands for a blank in pieces (fixed by the model format).
BLANK = "▁"
#: What an unknown id decodes to (fixed by the model format).
UNKNOWN_TEXT = " ⁇ "
#: Kinds of pieces and of models in the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: Largest model file that is broadcast.
MODEL_BYTES = 64 << 20
#: Units and pairs of neighbours that a worker remembers, and the longest such unit.
REMEMBERED_UNITS = 900_000
REMEMBERED_PAIRS = 400_000
REMEMBERED_LENGTH = 64
#: Characters of a text worked on at a time, and of the texts in an output batch.
SLICE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def _replace_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("quillrank.each_byte", _replace_byte)


class _Pairs(dict):
    """Whether two tokens are compatible neighbours."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, pair: tuple[str | None, str]) -> bool:
        if len(self) >= REMEMBERED_PAIRS:
            self.clear()
        known = self[pair] = self.model.compatible(*pair)
        return known


class _Shorter(dict):
    """The longest piece that is a shorter prefix of a token."""

    def __init__(self, pieces: set[str]):
        self.pieces = pieces

    def __missing__(self, token: str) -> str | None:
        known = self[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.pieces), None)
        return known


class _Ids(dict):
    """Ids of tokens; characters that are no piece have those of their bytes."""

    def __init__(self, ids: dict[str, bytes], byte_ids: dict[int, bytes]):
        super().__init__(ids)
        self.byte_ids = byte_ids

    def __missing__(self, token: str) -> bytes:
        return b"".join([self.byte_ids[b] for b in token.encode()])


class PieceModel:
    """A merge-type model with byte pieces, from the bytes of its file."""

    def __init__(self, data: bytes, remembered: int = REMEMBERED_UNITS):
        import ahocorasick

        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("the model is not a merge-type one with byte pieces alone")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model's normalizer rewrites more than blanks")
        self.prefix = BLANK if normalizer.get(3, 1) else ""
        self.end_id = trainer.get(42, 2)
        #: Rank of a piece: the less, the earlier it is merged.
        self.rank = {p: -score for p, score, kind in pieces if kind == NORMAL}
        byte_ids = {int(p[3:5], 16): struct.pack("<i", i) for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(byte_ids) < 256:
            raise ValueError("the model lacks byte pieces")
        self.ids = _Ids({p: struct.pack("<i", i) for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}, byte_ids)
        self.text_of = [self._surface(p, kind) for p, _, kind in pieces]
        self.leads_blank = np.array([kind == NORMAL and p.startswith(BLANK) for p, _, kind in pieces])
        #: Blanks part units if no piece has a blank behind something else.
        self.parts_at_blanks = bool(self.prefix) and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.rank)
        #: Characters that no merge touches stand alone; all others are matched, as pieces or as bytes.
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        self.alone = re.compile(f"[^{re.escape(''.join(sorted(joined)))}]") if joined else re.compile("(?s).")
        #: A unit is cut around them, and behind a letter where a character follows that no piece has there.
        behind = {p[i + 1] for p in self.rank for i in range(len(p) - 1) if _LETTER.match(p[i])}
        others = re.escape("".join(sorted(c for c in joined if c not in behind and not _LETTER.match(c))))
        self.cut = re.compile(f"({self.alone.pattern})" + (f"|(?<={_LETTER.pattern})(?=[{others}])" if others else ""), re.DOTALL)
        matched = joined | self.rank.keys()
        self.automaton = ahocorasick.Automaton()
        for piece in matched:
            self.automaton.add_word(piece, piece)
        if matched:
            self.automaton.make_automaton()
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.regular: dict[str, bool] = {}
        self.shorter, self.pairs = _Shorter(matched), _Pairs(self)
        #: Lengths of the pieces that begin with two characters, falling.
        lengths: dict[str, set[int]] = {}
        for piece in matched:
            lengths.setdefault(piece[:2], set()).add(len(piece))
        self.lengths = {start: sorted(found, reverse=True) for start, found in lengths.items()}
        self.separator = next(c for c in map(chr, range(1 << 16)) if c not in joined)
        #: Ids (as 32-bit integers) of the units between blanks, without their first blank, and of their further parts.
        self.units: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.remembered = remembered

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, piece.replace(BLANK, " ")).encode()

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens of a short text by merging from its characters, best rank and then leftmost first; and the last merge."""
        symbols, last = list(text), None
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols, last

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; None for a character and for a piece that merging does not make."""
        if piece not in self.splits:
            symbols, last = self.merge(piece) if len(piece) > 1 else ([piece], None)
            whole = len(symbols) == 1
            self.splits[piece] = last if whole else None
            self.regular[piece] = len(piece) == 1 or bool(whole and all(len(p) == 1 or (self.made(p) and self.regular[p] and self.rank[p] < self.rank[piece]) for p in last))
        return self.splits[piece]

    def made(self, piece: str) -> bool:
        """Whether merging the characters of ``piece`` makes it."""
        return self.split(piece) is not None or len(piece) == 1

    def compatible(self, a: str | None, b: str) -> bool:
        """Whether merging the text of ``a`` and ``b`` gives these two tokens (of ``b`` alone, if it is the first)."""
        rank, splits, regular = self.rank, self.splits, self.regular
        whole = self.made(b) if b not in regular or len(b) == 1 else splits[b] is not None
        if a is None or not whole:
            return whole
        if not (self.made(a) if a not in regular or len(a) == 1 else splits[a] is not None):
            return False
        if not (regular[a] and regular[b]):
            return self.merge(a + b)[0] == [a, b]
        before_a = before_b = math.inf  # rank of the merge that ends each side's present edge
        of_a = rank[a] if len(a) > 1 else -math.inf  # and of the one that made it
        of_b = rank[b] if len(b) > 1 else -math.inf
        while True:
            joined = rank.get(a + b)
            # Of equal ranks the leftmost merge comes first: that of the left side, then this one, then that of the right.
            if joined is not None and joined < before_a and joined <= before_b:
                return False
            if of_a > of_b:
                before_a, a = of_a, splits[a][1]
                of_a = rank[a] if len(a) > 1 else -math.inf
            elif of_b > -math.inf:
                before_b, b = of_b, splits[b][0]
                of_b = rank[b] if len(b) > 1 else -math.inf
            else:
                return True

    def _backtrack(self, text: str, longest: list[str], fit: int) -> list[str]:
        """The tokens of a text of mergeable characters, of whose longest matches the first ``fit`` are accepted and the next isn't."""
        pairs, shorter, lengths, pieces = self.pairs, self.shorter, self.lengths, self.shorter.pieces
        failed, size = None, len(text)
        out, token = longest[:fit], longest[fit]
        at = sum(map(len, out))
        number, begin = fit, at  # a place in the longest matches
        while True:
            token = shorter[token]
            if token is None:  # nothing fits here: something shorter for the token before
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                continue
            while True:
                end = at + len(token)
                if not pairs[out[-1] if out else None, token] or (failed and failed[end >> 3] >> (end & 7) & 1):
                    break
                out.append(token)
                at = end
                if at == size:
                    return out
                # The longest piece from here: known where a longest match began, else looked up.
                while begin < at:
                    begin += len(longest[number])
                    number += 1
                if begin == at:
                    token = longest[number]
                else:
                    for length in lengths.get(text[at : at + 2], ()):
                        token = text[at : at + length]
                        if token in pieces:
                            break
                    else:
                        token = text[at]

    def tokens(self, parts: list[str]) -> list[list[str]]:
        """The tokens of texts of mergeable characters: longest matches of all, then backtracking in those where some don't fit."""
        pairs, out = self.pairs, []
        matches = self.automaton.iter_long(self.separator.join(parts))
        last = -1
        for part in parts:
            found: list[str] = []
            last += len(part)
            for end, token in matches:
                found.append(token)
                if end == last:
                    break
            last += 1
            fits = list(map(pairs.__getitem__, zip([None, *found], found, strict=False)))
            if not all(fits):
                found = self._backtrack(part, found, fits.index(False))
            out.append(found)
        return out

    def _learn(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts that no merge leaves."""
        ids = self.ids
        for found in self.tokens(parts) if parts else ():
            yield b"".join(map(ids.__getitem__, found))

    def parts_of(self, unit: str) -> list[str]:
        return [p for p in self.cut.split(unit) if p]

    def whole_ids(self, text: str) -> bytes:
        """Ids of a text that isn't parted at blanks."""
        parts = self.parts_of(text)
        plain = [p for p in parts if not self.alone.match(p)]
        found = dict(zip(plain, self._learn(plain), strict=True))
        return b"".join([found.get(p) or self.ids[p] for p in parts])

    def unit_ids(self, units: list[str]) -> bytes:
        """Ids of units, of which those known are looked up."""
        known, tails = self.units, self.tails
        new = {u for u in units if u not in known}
        # Parts at most of them have in common: the first, which follows the blank, and the others.
        cut = [(u, self.parts_of(BLANK + u)) for u in new if self.cut.search(u)]
        if len(known) + len(tails) + len(new) + sum([len(p) for _, p in cut]) > self.remembered and (known or tails):
            known.clear()  # forget, and learn what these need
            tails.clear()
            new = set(units)
            cut = [(u, self.parts_of(BLANK + u)) for u in new if self.cut.search(u)]
        heads = dict.fromkeys([p[0][1:] for _, p in cut if p[0][1:] not in known])
        heads |= dict.fromkeys(new.difference([u for u, _ in cut]))
        others = {q for _, p in cut for q in p[1:] if q not in tails}
        tails.update((q, self.ids[q]) for q in others if self.alone.match(q))
        rest = [q for q in others if q not in tails]
        ids = self._learn([*(BLANK + h for h in heads), *rest])
        known.update(zip(heads, ids, strict=False))
        tails.update(zip(rest, ids, strict=True))
        known.update((u, known[p[0][1:]] + b"".join([tails[q] for q in p[1:]])) for u, p in cut)
        out = b"".join(map(known.__getitem__, units))
        for memory in (known, tails):
            for long in [u for u in (*new, *heads, *others) if len(u) > REMEMBERED_LENGTH]:
                memory.pop(long, None)
        return out

    def _slices(self, text: str) -> Iterator[str]:
        """The text in pieces' characters, cut before blanks that follow something else."""
        plain, at = self.prefix + text.replace(" ", BLANK), 0
        while self.parts_at_blanks and len(plain) - at > SLICE:
            found = _BOUNDARY.search(plain, at + SLICE)
            if not found:
                break
            yield plain[at : found.start() + 1]
            at = found.start() + 1
        yield plain[at:]

    def encode(self, text: str, end: bool = False) -> np.ndarray:
        """Ids of a text, with the end id behind them if asked for."""
        out = []
        for plain in self._slices(text) if text else ():
            if self.parts_at_blanks:
                # Every unit begins with a blank, which its key leaves out.
                out.append(self.unit_ids([u[1:] for u in _UNITS.findall(plain)] if BLANK * 2 in plain else plain.split(BLANK)[1:]))
            else:
                out.append(self.whole_ids(plain))
        if end:
            out.append(struct.pack("<i", self.end_id))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: blanks for their character, without the blank that encoding puts first."""
        data = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        if self.prefix:
            # Control pieces may come before the first one with a text.
            first = next((i for i in ids.tolist() if self.text_of[i]), None)
            if first is not None and self.leads_blank[first]:
                data = data[1:]
        return data.decode("utf-8", "quillrank.each_byte")


_LETTER = re.compile(r"[^\W\d_]")
_BOUNDARY = re.compile(f"[^{BLANK}]{BLANK}")
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*")


@functools.lru_cache(maxsize=1)
def piece_model(data: bytes) -> PieceModel:
    """One model a worker process."""
    return PieceModel(data)


def read_model(path: str) -> bytes:
    """A model file's bytes, if it is small enough to broadcast."""
    size = os.path.getsize(path)
    if size > MODEL_BYTES:
        raise ValueError(f"{path} has {size} bytes; models of up to {MODEL_BYTES} are broadcast")
    with open(path, "rb") as file:
        data = file.read()
    PieceModel(data)  # a wrong kind is an error here, not in the tasks
    return data


def encode_pieces(docs: DataFrame, path: str, carry: list[str], text_col: str = "text", end: bool = True) -> DataFrame:
    """Struct ``doc`` of the ``carry`` columns, ``ids`` and the text ``decoded`` from them, of each row."""
    doc = F.struct(*[col(c).alias(c) for c in carry] or [F.lit(0)]).alias("doc")
    row = docs.select(doc, col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    schema = row.select("doc", F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        for batch in batches:
            ids: list[np.ndarray] = []
            at = size = 0
            for text in texts(batch.column(1)):
                ids.append(model.encode(text, end))
                size += len(text)
                if size >= SLICE:
                    yield out(model, batch.column(0).slice(at, len(ids)), ids)
                    at, size = at + len(ids), 0
                    ids.clear()
            if ids:
                yield out(model, batch.column(0).slice(at, len(ids)), ids)

    def out(model: PieceModel, kept: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, ids)])
        column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        return pa.RecordBatch.from_arrays([kept, column, pa.array([model.decode(x) for x in ids], pa.string())], names=["doc", "ids", "decoded"])

    return row.mapInArrow(run, schema)
