"""What keeps the line join's shuffles and pairs few: bitmaps of long lines, the likeliest first pairs, entries sent as bytes."""

from __future__ import annotations

import numpy as np

from quillrank.llm import line_join
from quillrank.llm.words import word_hashes, words
from tests.llm.test_kernels import line_group


def long_group(lines: list[str]) -> dict[str, np.ndarray]:
    """Every line as one entry of one list, with its bitmaps."""
    (_, _, first, token), *_ = line_join.line_chunks(["\n".join(lines).encode()])
    found = line_join.prefix_entries(first, token, np.zeros(1 << 10, np.uint8), 50_000, 0.8)
    at = np.unique(found["line"], return_index=True)[1]
    group = {c: found[c][at] for c in ("n", "at", "bits", "b1", "b2", "b3")} | {"run": np.zeros(len(at), np.int64), "place": found["line"][at], "hint": found["line"][at]}
    order = np.argsort(group["n"], kind="stable")
    return {c: v.view(np.uint64)[order] if c[0] == "b" else v[order] for c, v in group.items()}


def test_bitmaps_tell_long_lines_apart():
    """Lines of 40 to 300 words that share nothing but some words make no pairs; near copies of them make all."""
    rng = np.random.default_rng(8)
    base = [[f"w{k}" for k in rng.choice(4000, n, replace=False)] for n in rng.integers(40, 300, 120)]
    near = [x[: len(x) - len(x) // 20] + [f"new{i}"] for i, x in enumerate(base)]
    group = long_group([" ".join(x) for x in base + near])
    place = group["place"]
    got = {(int(x), int(y)) for a, b in line_join.open_pairs(group, np.arange(len(place))) for x, y in zip(place[a], place[b], strict=True)}
    assert got >= {(120 + i, i) for i in range(120)} and len(got) <= 125
    again = line_join.unpacked(line_join._packed(group), np.arange(240))
    assert again.keys() == group.keys() and all((again[c] == group[c]).all() for c in group)


def test_the_first_pair_is_the_least_apart():
    words = [f"w{k}" for k in range(29)]
    lines = [[*words[:27], "x", "y"], [*words, "z"], words]
    group = line_group([" ".join(x) for x in lines])
    late, early = line_join.near_pairs(group)
    assert dict(zip(group["place"][late].tolist(), group["place"][early].tolist(), strict=True))[2] == 1


def test_entries_arrive_whole_at_their_tasks():
    rng = np.random.default_rng(9)
    sent = {c: rng.integers(0, 1 << (20 if kind == "<i4" else 62), 5000).astype(kind) for c, kind in line_join._ENTRY.items()}
    rows = line_join._dealt(sent, 7).to_pylist()
    assert [r["task"] for r in rows] == list(range(7))
    for r in rows:
        got = line_join._undealt([r["entries"]])
        mine = np.flatnonzero(sent["key"] % 7 == r["task"])
        mine = mine[np.argsort(sent["key"][mine])]
        assert all((got[c] == sent[c][mine]).all() for c in sent)
    both = line_join._undealt([r["entries"] for r in rows])
    assert sorted(both["h1"].tolist()) == sorted(sent["h1"].tolist())


def test_words_hashed_eight_bytes_at_a_time():
    """The words and their equality are those of ``words``; case, length, zero bytes and words of any length count."""
    rng = np.random.default_rng(10)
    some = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in range(1, 140) for _ in range(6)]
    some += [b"AbC", b"abc", b"abc\0", b"abc\0\0", "É".encode(), "é".encode(), b"a" * 64, b"A" * 64, b"a" * 65, b"A" * 65, b"\x1fx", b"\x7f", b"\x85"]
    parts = rng.choice([b" ", b"\n", b"\t", b"\x0b", b"\r", b"  \x0c"], len(some))
    data = np.frombuffer(b"".join(x + bytes(p) for x, p in zip(some * 2, [*parts, *parts], strict=True)), np.uint8)
    start, _, want = words(data)
    at, got = word_hashes(data)
    assert (at == start).all()
    assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(got.tolist())) == len(set(want.tolist()))
    assert all(len(x) == 0 for x in word_hashes(np.zeros(0, np.uint8)))
