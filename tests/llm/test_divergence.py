"""Operator 12 against a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import divergence
from quillrank.llm.queries import ORACLE, QUERIES
from tests import oracle_check
from tests.llm import cases


def plain(rows, least, top):
    """(lang, source, part, item, value, rank) of rows of (text, lang, source)."""
    n, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        n[lang, source].update(words)
        documents[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, d in documents[lang].items() if d >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // total for t in kept}

        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {
                "pair": [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items, 1) if part == "pair" or rank <= top}
    return out


def sample(seed):
    rng = random.Random(seed)
    words = [cases.word(rng) for _ in range(60)] + ["Éa", "zé", "漢字", "\U0001f600", "x"]
    weights = {s: [rng.random() ** 3 for _ in words] for s in "abcdefg"}
    data = [(i, " ".join(rng.choices(words, weights[s], k=rng.randint(0, 30))) + rng.choice([" 12", "", "-B_c"]), rng.choice(["en", "en", "fr"]), s, *[None] * 6) for i in range(120) for s in [rng.choice("abcdefg")]]
    data += [(1000, None, "en", "void", *[None] * 6), (1001, "unique", "xx", "one", *[None] * 6), (1002, "other", "xx", None, *[None] * 6), (1003, "alone", None, None, *[None] * 6)]
    return [*data, data[0], data[0]]


def all_rows(docs, least, top, **sizes):
    cells = divergence.kept_cells(docs, least).checkpoint()
    totals = divergence.group_totals(docs, cells).checkpoint()
    pairs = divergence.source_pairs(cells, totals, sizes.get("block_terms"), sizes.get("tile"))
    return pairs.unionByName(divergence.typical_terms(cells, totals, top, sizes.get("buffered")))


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 7, "tile": 2, "buffered": 25}])
def test_audit_against_a_plain_version(spark, sizes):
    data = sample(1)
    docs = cases.docs(spark, data, partitions=4)
    got = all_rows(docs, 4, 3, **sizes).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain([r[1:4] for r in data], 4, 3)


def test_awkward_rows(spark):
    for least in (1, 2, 10_000):
        got = divergence.audit(cases.docs(spark), least, 5)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert {tuple(r) for r in got.collect()} == plain([r[1:4] for r in cases.rows()], least, 5)
    assert divergence.audit(cases.empty(spark)).count() == 0


def test_skyband_against_all_pairs():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 400):
        for k in (1, 3, 10):
            n, lang_n = rng.integers(0, 12, size), rng.integers(0, 12, size)
            terms = np.array([f"{x:04d}" for x in rng.permutation(size)], object)
            dominated = [sum(n[a] >= n[b] and lang_n[a] <= lang_n[b] and terms[a] < terms[b] for a in range(size)) for b in range(size)]
            got = set(divergence.skyband(n, lang_n, terms, k, chunk=16).tolist())
            expected = {b for b in range(size) if dominated[b] < k}
            assert got == expected if size > k else got >= expected


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(3)
    pairs = [(c, max(1, c + 2) + rng.choice([0, 1, rng.randrange(1 << 50)])) for c in (rng.choice([0, 7, rng.randrange(1 << 50)]) for _ in range(300))]
    got = spark.createDataFrame(pairs, "n long, total long").select("n", "total", divergence.probability(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 2) // r.total for r in got)
    n, total = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    assert divergence._probabilities(n, total).tolist() == [1 + 10**9 * (a + 2) // b for a, b in pairs]


def test_counting_in_small_parts(spark, monkeypatch):
    docs = cases.docs(spark)
    whole = {tuple(r) for r in divergence.kept_cells(docs, 2).collect()}
    monkeypatch.setattr(divergence, "COUNTED", 5)
    assert {tuple(r) for r in divergence.kept_cells(docs, 2).collect()} == whole


def test_a_text_of_several_megabytes(spark):
    text = "lorem ipsum dolor " * 200_000
    data = [(i, t, "en", s, *[None] * 6) for i, (t, s) in enumerate([(text, "a"), ("lorem sit", "b"), ("sit", "c")])]
    got = divergence.audit(cases.docs(spark, data), 1, 5)
    assert {tuple(r) for r in got.collect()} == plain([r[1:4] for r in data], 1, 5)


def test_query_against_sql(spark):
    name = "op12_source_divergence"
    con = oracle_check.duck("/root/testdata/sf0.001")
    assert oracle_check.compare(spark, con, name, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")["ok"]
