"""Learning and scoring with Spark ML.

Fit: featured-population maxima (one aggregate) → labelled rows with the
usable-row filter → hash split → Pipeline[bucket SQLTransformer →
VectorAssembler → StandardScaler → classifier]. Three classifiers share one
persisted training frame. Score: ``transform`` over any feature table, then
the score rule. The fitted maxima live inside the saved PipelineModel (the
SQLTransformer statement), so save/load needs no side files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillrank.operators.buckets import bucket_sql, collect_maxima
from quillrank.operators.reports import display_score  # noqa: F401 (part of this module's interface)
from quillrank.operators.split import add_split
from quillrank.operators.tables import score_rule
from quillrank.operators.trees import NodeForest, fit_random_trees, forest_nodes, score_by_joins
from quillrank.sources.tables import materialize

# Default learning configuration (features, which are bucketed, split, trees, C).
DEFAULT_FEATURES = ["nImages", "nLinks", "nRefs", "nWordsSummary", "grade_level"]
DEFAULT_DISCRETIZE = {"nImages": True, "nLinks": True, "nRefs": True, "nWordsSummary": True, "grade_level": False}
TEST_SHARE = 0.4
N_TREES = 10
LOGREG_C = 0.35
MODEL_KINDS = ("rf", "logreg", "xtrees")


@dataclass
class QualityModels:
    features: list[str]
    maxima: dict[str, float | None]
    models: dict[str, PipelineModel] = field(default_factory=dict)
    n_train: int = 0


def usable_rows(table: DataFrame) -> DataFrame:
    """Labelled rows with meanWordLength and reading_ease present."""
    ok = F.lit(True)
    for c in ("meanWordLength", "reading_ease"):
        if c in table.columns:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return table.where((F.col("featured") | F.col("flagged")) & ok)


def with_label(df: DataFrame) -> DataFrame:
    """Q6: label = featured (1) / flagged (0); both set ⇒ featured wins."""
    return df.withColumn("label", F.when(F.col("featured"), 1.0).otherwise(0.0))


def _bucket_stage(maxima: dict[str, float | None]) -> SQLTransformer:
    cols = ", ".join(f"CAST({bucket_sql(f'`{f}`', m)} AS DOUBLE) AS `{f}__b`" for f, m in maxima.items())
    stmt = f"SELECT *, {cols} FROM __THIS__" if cols else "SELECT * FROM __THIS__"
    return SQLTransformer(statement=stmt)


def _classifier(kind: str, n_features: int, n_train: int, seed: int):
    subset = str(max(1, int(math.sqrt(n_features))))
    if kind == "rf":
        return RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=N_TREES, impurity="gini",
                                      featureSubsetStrategy=subset, maxDepth=30, maxBins=128, seed=seed)
    if kind == "logreg":
        return LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1.0 / (LOGREG_C * max(n_train, 1)),
                                  elasticNetParam=0.0, maxIter=200)
    raise ValueError(kind)


def build_pipeline(features: list[str], maxima: dict[str, float | None], kind: str, n_train: int, seed: int) -> Pipeline:
    inputs = [f"{f}__b" if f in maxima else f for f in features]
    return Pipeline(stages=[
        _bucket_stage(maxima),
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        _classifier(kind, len(features), n_train, seed),
    ])


def fit_xtrees(features: list[str], maxima: dict[str, float | None], train: DataFrame, seed: int) -> PipelineModel:
    """M8: extremely randomised trees over the bucketed features, as a pipeline model.

    Spark ML has none, so they are fitted level by level
    (``trees.fit_random_trees``); the fitted nodes are the table of a
    ``trees.NodeForest`` stage, so the model is saved, loaded and applied as
    any other.
    """
    inputs = ", ".join(f"CAST(`{f}__b` AS DOUBLE)" if f in maxima else f"CAST(`{f}` AS DOUBLE)" for f in features)
    assemble = SQLTransformer(statement=f"SELECT *, array({inputs}) AS x FROM __THIS__")
    bucket = _bucket_stage(maxima)
    rows = materialize(assemble.transform(bucket.transform(train)).select("x", "label"))
    table = fit_random_trees(rows, len(features), N_TREES, max(1, int(math.sqrt(len(features)))), seed + 1)
    score = NodeForest.over(table, "x", "_p")
    out = SQLTransformer(statement="SELECT *, array(1.0D - _p, _p) AS probability, CASE WHEN _p > 0.5D THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__")
    return PipelineModel(stages=[bucket, assemble, score, out])


def fit_models(table: DataFrame, features: list[str] | None = None, discretize: dict[str, bool] | None = None,
               kinds=MODEL_KINDS, test_share: float = TEST_SHARE, seed: int = 0,
               fit_on_train_only: bool = False) -> tuple[QualityModels, DataFrame]:
    """Fit the classifiers; returns the models and the labelled, split frame.

    Bucket maxima come from all featured pages (test part included), as in
    the original; ``fit_on_train_only`` restricts them to the training part.
    """
    features = list(features or DEFAULT_FEATURES)
    discretize = discretize or {f: f != "grade_level" for f in features}
    stats_rows = table
    if fit_on_train_only:
        stats_rows = add_split(table, "pageId", test_share, seed).where("is_train")
    maxima = collect_maxima(stats_rows, [f for f in features if discretize.get(f)])
    labelled = with_label(add_split(usable_rows(table), "pageId", test_share, seed))
    labelled = labelled.select("id", "pageId", "featured", "flagged", "label", "is_train", *features)
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    train = labelled.where("is_train")
    n_train = train.count()
    qm = QualityModels(features=features, maxima=maxima, n_train=n_train)
    try:
        for kind in kinds:
            qm.models[kind] = fit_xtrees(features, maxima, train, seed) if kind == "xtrees" else build_pipeline(features, maxima, kind, n_train, seed).fit(train)
    finally:
        # Later uses re-read the labelled rows from the (checkpointed) table;
        # nothing stays pinned in executor memory across queries.
        labelled.unpersist()
    return qm, labelled


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``p_high`` = P(label = 1) from the fitted pipeline."""
    out = model.transform(df)
    is_array = isinstance(out.schema["probability"].dataType, ArrayType)
    return out.withColumn("p_high", (F.col("probability") if is_array else vector_to_array(F.col("probability"))).getItem(1))


def stored_scores(spark: SparkSession, path: str, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, p_stored): scores worked out from what a saved model holds, without its classifier.

    A forest is read as a table of nodes that rows are sent down, randomised trees are walked with joins over their node rows, and the
    logistic model is its coefficients.
    """
    model = load_model(path)
    last = model.stages[-1]
    if isinstance(last, SQLTransformer):
        x = df
        for stage in model.stages[:-2]:
            x = stage.transform(x)
        nodes = spark.read.parquet(f"{path.rstrip('/')}/stages/{len(model.stages) - 2}_{model.stages[-2].uid}/nodes")
        return score_by_joins(x, nodes, id_col).withColumnRenamed("p_high", "p_stored")
    x = df
    for stage in model.stages[:-1]:
        x = stage.transform(x)
    x = x.withColumn("_x", vector_to_array("scaled"))
    if hasattr(last, "trees"):
        score = forest_nodes(spark, path).score_column(spark, "_x")
    else:
        weighted = [F.get("_x", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(last.coefficients)]
        score = 1 / (1 + F.exp(-(sum(weighted[1:], weighted[0]) + F.lit(float(last.intercept)))))
    return x.select(F.col(id_col).alias("id"), score.alias("p_stored"))


def score_table(model: PipelineModel, table: DataFrame, features: list[str]) -> DataFrame:
    """The whole table re-scored in one transform (no per-row loop)."""
    scored = probability(model, table)
    rule = score_rule(F.col("featured"), F.col("flagged"), [F.col(f) for f in features], F.col("p_high"))
    return scored.withColumn("score", rule)


def model_report(qm: QualityModels, labelled: DataFrame) -> DataFrame:
    """Accuracy, recall, precision per (model, split) from confusion sums."""
    frames = []
    for kind, model in qm.models.items():
        pred = model.transform(labelled).select(F.lit(kind).alias("model"),
                                                F.when(F.col("is_train"), "train").otherwise("test").alias("split"),
                                                "label", "prediction")
        frames.append(pred)
    allp = frames[0]
    for f in frames[1:]:
        allp = allp.unionByName(f)
    return confusion_metrics(allp, ["model", "split"])


def confusion_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy / recall / precision from conditional sums (one aggregation)."""
    tp = F.sum(F.when((F.col("label") == 1) & (F.col("prediction") == 1), 1).otherwise(0))
    fp = F.sum(F.when((F.col("label") == 0) & (F.col("prediction") == 1), 1).otherwise(0))
    fn = F.sum(F.when((F.col("label") == 1) & (F.col("prediction") == 0), 1).otherwise(0))
    ok = F.sum(F.when(F.col("label") == F.col("prediction"), 1).otherwise(0))
    g = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ok.alias("n_correct"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return g.select(*keys, "n", "tp", "fp", "fn",
                    (F.col("n_correct") / F.col("n")).alias("accuracy"),
                    F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"),
                    F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def feature_importances(qm: QualityModels, kind: str = "rf") -> DataFrame:
    """(feature, importance) of a tree model, one row per input feature."""
    model = qm.models[kind]
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(qm.features, imp)], "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline (maxima included in the bucket stage)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
