"""Operator 13 against numpy and exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quillrank.llm import whitening
from quillrank.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, doc string, n int, vector string"


def rows(seed=3, n=300, size=7):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, size)) @ rng.normal(size=(size, size))
    values[:, 2] = 0.25  # a constant entry
    values[:, 5] = values[:, 1]  # a repeated one
    out = [(i, v.tolist(), "d", 1, "v") for i, v in enumerate(values)]
    odd = [None, [], [1.0] * (size - 1) + [None], [1.0] * (size - 1) + [math.nan], [math.inf] + [1.0] * (size - 1), [1.0] * (size + 1)]
    return [*out, out[0], out[0], (None, out[1][1], None, None, None), *[(900 + i, v, None, None, None) for i, v in enumerate(odd)]]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain(data, size=7):
    """Rows that stay, their whole numbers, and the covariance, in exact arithmetic."""
    kept = [r for r in data if r[1] is not None and len(r[1]) == size and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in r[1]] for r in kept]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    cov = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(size)] for i in range(size)]
    return kept, x, sums, np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])


def test_whitening_against_exact_covariance(spark):
    data = rows()
    kept, x, sums, cov = plain(data)
    n, want = len(kept), np.linalg.eigvalsh(cov)[::-1][:5]
    got = whitening.whiten(frame(spark, data), ["vec_id", "doc", "n", "vector"]).select("doc.vec_id", "component", "n", "deviation", "deviation_decimal", "whitened", "explained", "identity_error").toPandas()
    assert got["component"].nunique() == 5 and len(got) == 5 * n  # one constant and one repeated entry
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] <= 1e-9
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, want / np.trace(cov), rtol=1e-9)
    deviations = {r[0]: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for r, v in zip(kept, x, strict=True)}
    assert all(d == deviations[None if math.isnan(i) else int(i)] for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    assert (got["deviation"] == got["deviation_decimal"].astype(object)).all()
    wide = got[got["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    model = whitening.fit(whitening.usable(frame(spark, data), ["vec_id"], "embedding"))
    mean = np.array([s / n for s in sums])
    by_id = {r[0]: np.array(v, float) - mean for r, v in zip(kept, x, strict=True)}
    expected = np.stack([by_id[i] @ model.components / np.sqrt(model.eigenvalues) for i in wide.index])
    assert np.allclose(wide.to_numpy(), expected, atol=1e-9)
    assert np.allclose(cov @ model.components, model.components * model.eigenvalues, atol=1e-9 * want[0])
    assert np.allclose(model.components.T @ model.components, np.eye(5), atol=1e-12)


def test_the_way_rows_are_dealt_changes_nothing(spark):
    data = rows()
    models = [whitening.fit(whitening.usable(spark.createDataFrame(data, SCHEMA).repartition(k), ["vec_id"], "embedding")) for k in (1, 5)]
    assert models[0].sums == models[1].sums and (models[0].components == models[1].components).all()


def test_factor_and_rotation():
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (2, 1), (9, 9), (12, 4), (40, 40)):
        base = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-3, 4, rank)
        matrix = base @ base.T
        factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape[1] <= size and np.allclose(factor @ factor.T, matrix, atol=1e-12 * np.abs(matrix).max())
        rotated = whitening.orthogonal_columns(factor)
        norms = np.sort((rotated**2).sum(0))[::-1]
        true = np.linalg.eigvalsh(matrix)[::-1]
        assert np.allclose(norms, true[: len(norms)], rtol=1e-9, atol=1e-12 * true[0])
        inner = rotated.T @ rotated
        assert np.abs(inner - np.diag(np.diag(inner))).max() <= 1e-11 * true[0]
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape[1] == 0


@pytest.mark.parametrize("big", [1e3, 1e9, 1e15, 1e300])
def test_exact_sums_of_any_size(spark, big):
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in rng.normal(size=3) * big], None, None, None) for i in range(20)]
    model = whitening.fit(whitening.usable(frame(spark, data), [], "embedding"), 3)
    bound = 1 << 53
    x = [[max(-bound, min(bound, math.floor(64 * Fraction(c)))) + 1_000_000 for c in r[1]] for r in data]
    assert model.sums == [sum(c) for c in zip(*x, strict=True)]
    expected = [sum((20 * a - s) ** 2 for a, s in zip(v, model.sums, strict=True)) for v in x]
    assert model.deviations(np.array(x)) == expected
    mean = [s // 20 for s in model.sums]
    products = whitening.scatter(whitening.usable(frame(spark, data), [], "embedding"), 3, mean)
    assert products == [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) for j in range(i + 1)] for i in range(3)]
    got = {r.vec_id: (r.deviation, r.deviation_decimal) for r in whitening.whiten(frame(spark, data), ["vec_id"]).select("doc.vec_id", "deviation", "deviation_decimal").collect()}
    for i, e in enumerate(expected):
        assert got[i][0] == (e if e < 1 << 63 else None)
        assert got[i][1] is None or int(got[i][1]) == e
        assert got[i][1] is not None or e > 10**37


def test_nothing_to_scale_by(spark):
    one = [1.0, 2.0]
    for data in ([], [(1, one, None, None, None)], [(i, one, None, None, None) for i in range(4)], [(1, None, None, None, None), (2, [], None, None, None)]):
        assert whitening.whiten(spark.createDataFrame(data, SCHEMA), ["vec_id"]).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 4097, None, None, None)], SCHEMA), ["vec_id"])


def test_query_against_numpy(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    got = QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    x = np.floor(64 * np.stack(source["embedding"].to_numpy()).astype(float)) + 1_000_000
    cov = np.cov(x.T, bias=True)
    true, vectors = np.linalg.eigh(cov)
    true, vectors = true[::-1], vectors[:, ::-1]
    k = min(32, x.shape[1])
    assert len(got) == k * len(source) and got["identity_error"].max() <= 1e-6
    assert np.allclose(got.groupby("component")["explained"].first(), true[:k] / true.sum(), rtol=1e-6)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[source["vec_id"]].to_numpy()
    expected = (x - x.mean(0)) @ vectors[:, :k] / np.sqrt(true[:k])
    apart = np.abs(np.diff(true[: k + 1])).min() > 1e-6
    assert not apart or np.allclose(np.abs(wide), np.abs(expected), atol=1e-5)
