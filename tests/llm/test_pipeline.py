"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from quillrank.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import plain_components, plain_fingerprint, plain_leaks
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = {1: "decontamination", 2: "source_mixing", 3: "simhash_components", 4: "sentence_spans", 5: "importance_resampling", 6: "line_join", 7: "crf_language", 8: "order_minhash", 9: "token_shards", 10: "secret_novelty", 11: "piece_bpe", 12: "source_divergence", 13: "embedding_whitening"}


def test_all_queries_are_registered():
    assert set(QUERIES) == {f"op{n}_{name}" for n, name in NAMES.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)["ok"]


# Operators 12 and 13 return groups and vectors, see their own tests.
@pytest.mark.parametrize("name", sorted(f"op{n}_{name}" for n, name in NAMES.items() if n <= 11))
def test_queries_return_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF).collect()) == ids


def test_stages(spark):
    """Each stage against its rule on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_classifier"](spark, docs, SF).checkpoint()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, q in quality.items() if q]
    assert sum(d in kept for d in clean) >= 0.9 * len(clean)

    rows = good.collect()
    apart = stages["simhash_near_dedup"](spark, good, SF).checkpoint()
    groups = plain_components([plain_fingerprint(r.text) for r in rows], 2)
    least = {}
    for r in rows:
        g = groups[plain_fingerprint(r.text)]
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert apart.columns == docs.columns and {r.doc_id for r in apart.collect()} == set(least.values())

    unleaked = stages["benchmark_decontamination"](spark, apart, SF).checkpoint()
    assert unleaked.columns == docs.columns
    before = {r.doc_id: r.text for r in apart.collect()}
    for r in unleaked.collect():
        assert (r.text == before[r.doc_id]) == (plain_leaks(before[r.doc_id], items)[1] == 0) and r.n_chars == len(r.text)
    assert {d for d, t in before.items() if not plain_leaks(t, items)[1]} <= {r.doc_id for r in unleaked.collect()}

    mixed = stages["source_mixing"](spark, unleaked, SF).checkpoint()
    assert mixed.columns == docs.columns and mixed.join(unleaked, docs.columns, "left_anti").count() == 0
    out = stages["token_output"](spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and sorted(r.start for r in out)[0] == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
