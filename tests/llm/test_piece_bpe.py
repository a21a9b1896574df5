"""Operator 11 against the sentencepiece library and against merging whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quillrank.llm import piece_bpe
from quillrank.llm.queries import QUERIES
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(piece_bpe.read_model(PATH))


def texts(library, n=1500):
    rng = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(3, library.vocab_size())]
    yield from ("", " ", "  ", " " * 33, " " * 1001, "a" * 1000, "▁", "▁▁ a", "\n\n", "the " * 50, "-" * 77, "=" * 64, "<s></s><unk><0x0A>", "\x00", "�")
    for _ in range(n):
        yield "".join(rng.choice("abcdeeeetthhoninr  \n\t▁.,é漢字日本①\U0001f600ß\x00<0x>A") for _ in range(rng.randint(0, 40)))
        yield "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        yield "".join(rng.choice("ab e") for _ in range(rng.randint(0, 30)))
        yield "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x2000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 20)))


def test_ids_and_texts_equal_the_library(library, model):
    for t in texts(library):
        expected = library.encode(t)
        got = model.encode(t)
        assert got.tolist() == expected, t
        assert model.decode(got) == library.decode(expected), t


def test_any_ids_decode_as_the_library_does(library, model):
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, "<i4")) == library.decode(ids), ids


def test_backtracking_equals_merging(library, model):
    for t in texts(library, 200):
        unit = ("▁" + t.replace(" ", "▁"))[:60]
        parts = [p for p in model.parts_of(unit) if not model.alone.match(p)]
        assert model.tokens(parts) == [model.merge(p)[0] for p in parts]


def test_forgetting_and_slices_change_nothing(library, monkeypatch):
    small = piece_bpe.PieceModel(piece_bpe.read_model(PATH), remembered=5)
    monkeypatch.setattr(piece_bpe, "SLICE", 7)
    monkeypatch.setattr(piece_bpe, "REMEMBERED_PAIRS", 3)
    monkeypatch.setattr(piece_bpe, "REMEMBERED_LENGTH", 4)
    for t in texts(library, 150):
        assert small.encode(t).tolist() == library.encode(t)
        assert len(small.units) <= max(5, len(t) + 1)


def test_a_text_of_several_megabytes(library, model):
    rng = random.Random(7)
    words = [cases.word(rng) for _ in range(4000)]
    for t in (" ".join(rng.choice(words) for _ in range(400_000)), "".join(rng.choice(words) for _ in range(300_000))):
        assert len(t) > 1_000_000
        got = model.encode(t)
        assert got.tolist() == library.encode(t) and model.decode(got) == t


def test_rows(spark, library):
    got = piece_bpe.encode_pieces(cases.docs(spark), PATH, ["doc_id", "text", "doc"]).select("doc.*", "ids", "decoded").collect()
    assert len(got) == len(cases.rows())
    for r in got:
        ids = [*library.encode(r.text or ""), 2]
        assert (list(r.ids), r.decoded) == (ids, library.decode(ids))
    without = piece_bpe.encode_pieces(cases.docs(spark), PATH, ["text"], end=False).collect()
    assert all(list(r.ids) == library.encode(r.doc.text or "") for r in without)
    assert piece_bpe.encode_pieces(cases.empty(spark), PATH, ["doc_id"]).count() == 0


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op11_piece_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = [*library.encode(docs[r.doc_id]), 2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def _message(*fields):
    out = b""
    for number, value in fields:
        out += bytes([number << 3 | 2, len(value)]) + value if isinstance(value, bytes) else bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
    return out


def test_other_models_are_refused():
    for trainer in (_message((3, 1)), _message((3, 2)), _message((3, 2), (35, 1))):  # not merges; no byte pieces; none listed
        with pytest.raises(ValueError):
            piece_bpe.PieceModel(_message((2, trainer), (3, _message((4, 0)))))
