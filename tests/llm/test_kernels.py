"""The Spark-free parts against plain versions."""

import itertools
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillrank.llm import crf_language, line_join, mixing, sentence_spans, simhash
from quillrank.llm.fm_index import FMIndex
from quillrank.llm.token_shards import Encoder, TokenShard, encoder
from quillrank.llm.wavelet import WaveletMatrix

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "size"), [(0, 3), (1, 1), (64, 3), (65, 2), (1000, 7), (3000, 50_000)])
def test_wavelet_matrix(n, size):
    values = np.random.default_rng(n).integers(0, size, n)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(values, 16).to_bytes())
    assert (matrix.values() == values).all() and (matrix.access(np.arange(n)) == values).all()
    for x in range(min(size, 8)):
        at = np.flatnonzero(values == x)
        assert matrix.count(x) == len(at) and (matrix.occurrences(x) == at).all()
        assert (matrix.rank(np.full(n + 1, x), np.arange(n + 1)) == np.concatenate([[0], np.cumsum(values == x)])).all()


@pytest.mark.parametrize("n", [1, 4, 300, 2000])
def test_fm_index_finds_all_occurrences(n):
    rng = np.random.default_rng(n)
    text = rng.integers(0, 4, n)
    index = FMIndex(text, 4)
    for length in (1, 2, 6):
        patterns = rng.integers(0, 4, (30, length))
        for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
            want = [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi))) == want


def test_trie_join_gives_all_pairs_within_the_budget():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(6)} | {0, 1, 3, (1 << 64) - 1})
    array = np.array(values, np.uint64)
    for budget in (0, 1, 2, 5):
        for frontier in (8, 1 << 20):
            got = {(int(a), int(b)) for x, y in simhash.trie_pairs(np.zeros(len(array), np.int64), array, budget, frontier) for a, b in zip(x, y, strict=True)}
            want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= budget}
            assert {tuple(sorted(p)) for p in got} == want


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    transitions, lengths = rng.normal(size=(3, 3)), np.array([1, 5, 4, 7])
    scores = rng.normal(size=(int(lengths.sum()), 3)) * 2
    for block in (2, 3, 32):
        gamma, pairs = crf_language.posteriors(scores, transitions, lengths, block, pairs=True)
        at, expected = 0, np.zeros((3, 3))
        for n in lengths:
            want, total = np.zeros((n, 3)), 0.0
            between = np.zeros((3, 3))
            for path in itertools.product(range(3), repeat=int(n)):
                weight = np.exp(sum(scores[at + i, s] for i, s in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
                total += weight
                want[np.arange(n), path] += weight
                for a, b in itertools.pairwise(path):
                    between[a, b] += weight
            assert np.allclose(gamma[at : at + n], want / total)
            expected += between / total
            at += n
        assert np.allclose(pairs, expected)


def test_crf_follows_a_switch_of_language():
    rng = random.Random(1)
    stock = {"aa": ["kali", "molo", "kumo", "lakka"], "bb": ["strend", "grift", "spront", "thrund"]}
    samples = [(s, [rng.choice(stock[s]) for _ in range(60)]) for s in stock for _ in range(20)]
    model = crf_language.train(samples)
    words = [rng.choice(stock["aa"]) for _ in range(30)] + [rng.choice(stock["bb"]) for _ in range(30)]
    gamma, _ = crf_language.posteriors(model.scores(words), model.transitions, np.array([60]))
    assert [model.languages[i] for i in gamma.argmax(1)] == ["aa"] * 30 + ["bb"] * 30
    assert crf_language.label_texts(crf_language.WordScores(model), ["Kali molo kumo", "12 34", "", "grift"])[0] == ["aa", "und", "und", "bb"]
    assert crf_language.train([]) is None


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r", " ", " ", "a", "bc", "d.", "e,f", "!", "g.\n", "x's.", "'s", "don't", "12", "é", "漢", "\U0001f600", "…", "<|endoftext|>", ".", "\x01", "_x", "ﬀ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "x" * 5000, "ab cd " * 3000]
    encoder = Encoder(TOKENIZER)
    got = [x.tolist() for ids, counts in encoder.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_a_text_are_those_of_the_plain_call():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "a", "bc", "d.", "é", "漢", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [None, "a <|endoftext|> b"]
    got = [x.tolist() for ids, counts in encoder(TOKENIZER, 1 << 20, 600_000).encode(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[-1] == [64, 220, 50256, 275]


def test_token_shard_lookups():
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 50_257, n) for n in (1, 40, 7, 300)] + [np.array([2])]
    shard = TokenShard.from_bytes(TokenShard.of(np.concatenate(documents), np.array([len(d) for d in documents])).to_bytes())
    assert len(shard) == 5 and all((shard.document(i) == d).all() for i, d in enumerate(documents))
    token = int(documents[3][17])
    want = [(i, j) for i, d in enumerate(documents) for j, x in enumerate(d) if x == token]
    assert shard.occurrences(token) == want and shard.count(token) == len(want)
    assert shard.count(1 << 17) == 0 and shard.occurrences(1 << 17) == []


def test_min_cost_flow_fills_quotas_and_spreads_repetition():
    capacities = {("a",): 10, ("a", "b"): 20, ("b",): 5, ("c",): 4}
    flows = mixing.route(capacities, {"a": 22, "b": 18, "c": 40})
    assert sum(f.get("a", 0) for f in flows.values()) == 22 and sum(f.get("b", 0) for f in flows.values()) == 18
    assert sum(flows[("c",)].values()) == 12  # three times its size
    assert all(sum(f.values()) <= 3 * capacities[p] for p, f in flows.items())
    # 40 words of 35: no pattern is used a third time while another has a second use left.
    assert max(sum(flows[p].values()) / capacities[p] for p in capacities if p != ("c",)) <= 2


def test_capped_targets_reshare_the_excess():
    targets = mixing.capped_targets({"a": 100, "b": 1, "c": 100}, {"a": 1, "b": 2, "c": 3}, 201)
    assert targets["b"] == 3 and abs(targets["a"] - 49.5) < 1e-9 and abs(targets["c"] - 148.5) < 1e-9
    assert mixing.cycled_weights(["z", None, "B", "a"]) == {"B": 1, "a": 2, "z": 3, None: 1}


def plain_sets(text: str) -> list[frozenset]:
    return [frozenset(x.lower().split()) for x in text.split("\n")]


def line_group(lines: list[str], crowded: int = 50_000, hint=None) -> dict[str, np.ndarray]:
    """Entries of lines as a task holds them."""
    first, token = [], []
    for _, _, f, t in line_join.line_chunks(["\n".join(lines).encode()]):
        first, token = f, t
    counts = np.bincount((token & np.uint64(line_join.COUNTS - 1)).astype(np.int64), minlength=line_join.COUNTS)
    rarity = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)
    found = line_join.prefix_entries(first, token, rarity, crowded, 0.8)
    order = np.lexsort((found["at"], found["n"], found["key"]))
    key, place, n, at, bits = (found[c][order] for c in ("key", "line", "n", "at", "bits"))
    one = np.flatnonzero(~pd.DataFrame({"k": key, "p": place}).duplicated().to_numpy())
    key, place, n, at, bits = (x[one] for x in (key, place, n, at, bits))
    run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    return {"run": run, "n": n, "at": at, "place": place, "bits": bits.view(np.uint64), "hint": (np.arange(len(lines)) if hint is None else hint)[place]}


def test_packed_entries_are_whole():
    group = line_group([f"a{i % 7} b{i % 5} c{i % 3} d e f g{i}" for i in range(60)])
    again = line_join.unpacked(line_join._packed(group), np.arange(60))
    assert group.keys() == again.keys() and all((group[c] == again[c]).all() for c in group)


def test_candidate_pairs_hold_all_similar_lines():
    """Prefix, positional, length and bitmap filters lose nothing, crowded words included."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rng.sample(vocabulary, rng.randint(4, 20)) for _ in range(40)]
    lines = [" ".join(b) for b in base] + [" ".join(x for x in b if rng.random() > 0.12) for b in base * 3]
    lines = sorted({x for x in lines if x})
    sets = [frozenset(x.split()) for x in lines]
    want = {(j, i) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 20
    for crowded in (1, 8, 50_000):
        group = line_group(lines, crowded)
        place = group["place"]
        got = {(int(x), int(y)) for a, b in line_join.open_pairs(group, np.arange(len(place))) for x, y in zip(place[a], place[b], strict=True)}
        assert want <= got and all(i > j for i, j in got)
        late, early = line_join.near_pairs(group)
        near = set(zip(place[late].tolist(), place[early].tolist(), strict=True))
        assert near <= got and len(near) == len({i for i, _ in near})
        some = np.flatnonzero(place % 3 == 0)
        part = {(int(x), int(y)) for a, b in line_join.open_pairs(group, some) for x, y in zip(place[a], place[b], strict=True)}
        assert part == {(i, j) for i, j in got if i % 3 == 0}
        # Without an order both ways are given.
        either = line_group(lines, crowded, np.zeros(len(lines), np.int64))
        both = {(int(x), int(y)) for a, b in line_join.open_pairs(either, np.arange(len(place))) for x, y in zip(place[a], place[b], strict=True)}
        assert both == got | {(j, i) for i, j in got}


def test_open_pairs_in_small_parts(monkeypatch):
    lines = [" ".join([*(f"w{k}" for k in range(12)), f"x{i}"]) for i in range(30)]
    group = line_group(lines)

    def pairs():
        return {(int(x), int(y)) for a, b in line_join.open_pairs(group, np.arange(len(group["place"]))) for x, y in zip(group["place"][a], group["place"][b], strict=True)}

    whole = pairs()
    monkeypatch.setattr(line_join, "PAIRS", 7)
    assert pairs() == whole and len(whole) == 30 * 29 // 2


def test_words_are_sorted_in_lines_however_many_lines():
    rng = np.random.default_rng(3)
    line, value = np.sort(rng.integers(0, 100, 1000)), rng.integers(0, 1 << 60, 1000, np.uint64)
    want = value[np.lexsort((value, line))]
    assert (line_join._sorted_in_lines(line, value, 60) == want).all()  # 16 lines at a time


def test_entries_of_a_text_of_300_000_lines():
    """Lines 2^18 apart are not mixed up: the entries are those of the text's parts."""
    rng = np.random.default_rng(4)
    lines = [" ".join(map(str, row)) for row in rng.integers(0, 5000, (300_000, 6))]
    rarity = rng.integers(0, 18, 1 << 10).astype(np.uint8)

    def entries(some, base):
        out = []
        for _, number, first, token in line_join.line_chunks(["\n".join(some).encode()]):
            found = line_join.prefix_entries(first, token, rarity, 1 << 10, 0.8)
            out.append(np.stack([found["key"], number[found["line"]] + base, found["n"], found["at"], found["bits"]]))
        out = np.concatenate(out, axis=1)
        return out[:, np.lexsort(out)]

    parts = [entries(lines[at : at + 100_000], at) for at in range(0, 300_000, 100_000)]
    parts = np.concatenate(parts, axis=1)
    assert (entries(lines, 0) == parts[:, np.lexsort(parts)]).all()


def test_sentences_of_a_pasted_passage_are_cut_alike():
    rng = random.Random(2)
    from tests.llm.cases import sentence, text

    passage = " ".join(sentence(rng, 11) for _ in range(6))
    hashes = []
    for a, b in ((sentence(rng, 30)[:-1], text(rng, 3)), (text(rng, 2), sentence(rng, 4)), ("", "")):
        stops, owner, _, hashed = sentence_spans._sentences([f"{a} {passage} {b}".encode()])
        first, end = sentence_spans._spans(stops, owner)
        starts = np.concatenate([[0], stops])
        hashes.append(set(sentence_spans.run_hashes(hashed, starts[first], starts[end]).tolist()))
    assert len(hashes[0] & hashes[1] & hashes[2]) >= 2


def spans_of(text: str) -> set[int]:
    stops, _, _, hashed = sentence_spans._sentences([text.encode()])
    first, end = sentence_spans._spans(stops, np.zeros(len(stops), np.int64))
    starts = np.concatenate([[0], stops])
    return set(sentence_spans.run_hashes(hashed, starts[first], starts[end]).tolist())


@pytest.mark.parametrize("stop", [0.0, 0.1, 0.4])
def test_every_passage_of_51_words_holds_a_common_span(stop):
    rng = random.Random(8)

    def some(n):
        return " ".join(f"w{rng.randrange(3000)}" + "." * (rng.random() < stop) for _ in range(n))

    assert sentence_spans.PASSAGE <= 51
    for _ in range(500):
        passage = some(51)
        a, b = (f"{some(rng.randrange(40))} {passage}{rng.choice([' ', chr(10)])}{some(rng.randrange(40))}" for _ in range(2))
        assert spans_of(a) & spans_of(b)


def test_every_passage_of_51_code_points_without_blanks_holds_a_common_span():
    rng = random.Random(9)

    def some(n):
        return "".join(rng.choice(["。", "？"]) if rng.random() < 0.05 else chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))

    for _ in range(300):
        passage = some(51)
        a, b = (f"{some(rng.randrange(40))}{passage}{some(rng.randrange(40))}" for _ in range(2))
        assert spans_of(a) & spans_of(b)
    text = "abc漢字。def ghi. กข 한국 हि"
    start, end, _, last = sentence_spans._words(np.frombuffer(text.encode(), np.uint8))
    found = [text.encode()[i:j].decode() for i, j in zip(start, end, strict=True)]
    assert found == ["abc", "漢", "字", "。", "def", "ghi.", "ก", "ข", "한국", "हि"]
    assert last.tolist() == [f in ("。", "ghi.") for f in found]
