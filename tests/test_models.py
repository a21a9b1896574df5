"""Invariants of the fitted models and scores (rows-only queries)."""

import math

from pyspark.sql import functions as F

from quillrank.operators.split import add_split
from quillrank.plans import learning as L
from quillrank.plans.corpus import doc_feature_table
from quillrank.plans.q_model import MODEL_FEATURES, TABLE_NEEDS
from quillrank.sources import materialize
from tests.conftest import SF01


def test_scores_and_roundtrip(spark, tmp_path):
    t = materialize(doc_feature_table(spark, SF01, TABLE_NEEDS))
    qm, labelled = L.fit_models(t, MODEL_FEATURES, kinds=("rf",))
    s = L.score_table(qm.models["rf"], t, MODEL_FEATURES).select("id", "featured", "flagged", "score", "p_high")
    rows = s.collect()
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert all(r["score"] == 1.0 for r in rows if r["featured"])
    assert all(r["score"] == 0.0 for r in rows if r["flagged"] and not r["featured"])
    imp = L.feature_importances(qm).collect()
    assert math.isclose(sum(r["importance"] for r in imp), 1.0, rel_tol=1e-9)
    path = str(tmp_path / "m")
    L.save_model(qm.models["rf"], path)
    again = L.probability(L.load_model(path), t).select("id", F.col("p_high").alias("p2"))
    j = s.join(again, "id")
    assert j.where(F.col("p_high") != F.col("p2")).count() == 0
    rep = L.model_report(qm, labelled).collect()
    assert {(r["model"], r["split"]) for r in rep} == {("rf", "train"), ("rf", "test")}


def test_split_independent_of_partitioning(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "pageId")
    a = add_split(df.repartition(1), "pageId").where("is_train").select("pageId")
    b = add_split(df.repartition(8), "pageId").where("is_train").select("pageId")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    share = a.count() / 5000
    assert 0.55 < share < 0.65
