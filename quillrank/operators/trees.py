"""Decision trees as tables of nodes (M6, M8, M11): fitting randomised trees, and scores of stored trees.

A node row is (tree, node, feature, threshold, left, right, p, n): inner nodes
send a row whose feature is at most the threshold to ``left``, others (a
missing value counts as above everything) to ``right``; leaves have -1 there
and ``p``, the share of high-quality training rows. Node ``t`` is the root of
tree ``t``. A forest's score is the mean of its trees' leaves.

The nodes of a model stay out of Spark's plans, which the driver keeps as
texts: tasks get them as a broadcast variable (some bytes a node) and send
whole batches of rows down the trees.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.broadcast import Broadcast
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, p double, n long"
#: Trees are fitted to this depth and number of nodes in all at most; what is open then are leaves.
MAX_DEPTH = 30
MAX_NODES = 200_000
_COLUMNS = {"tree": np.int32, "node": np.int32, "feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "p": np.float64, "n": np.int64}


class TreeTable:
    """Node rows of some trees, by number: one numpy array a column."""

    def __init__(self, rows: list[tuple] | dict[str, np.ndarray]):
        if isinstance(rows, list):
            values = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
            rows = dict(zip(_COLUMNS, values, strict=True))
        order = np.argsort(np.asarray(rows["node"], np.int32), kind="stable")
        self.columns = {c: np.asarray(rows[c], kind)[order] for c, kind in _COLUMNS.items()}

    @property
    def rows(self) -> list[tuple]:
        return list(zip(*(c.tolist() for c in self.columns.values()), strict=True))

    @property
    def trees(self) -> int:
        return len(np.unique(self.columns["tree"]))

    def depth(self) -> int:
        """Steps from a root to the farthest leaf."""
        at, steps = np.arange(self.trees), 0
        while len(at := at[self.columns["left"][at] >= 0]):
            at, steps = np.concatenate([self.columns["left"][at], self.columns["right"][at]]), steps + 1
        return steps

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table(self.columns), NODE_SCHEMA)

    @classmethod
    def of(cls, frame: DataFrame) -> TreeTable:
        """A stored table of nodes; its size is that of the model."""
        found = frame.select(*_COLUMNS).toArrow()
        return cls({c: found[c].to_numpy() for c in _COLUMNS})

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The leaf that each row of features reaches in each tree, rows by trees."""
        feature, threshold, left, right = (self.columns[c] for c in ("feature", "threshold", "left", "right"))
        at = np.tile(np.arange(self.trees, dtype=np.int32), (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth() if depth is None else depth):
            value = x[row, np.maximum(feature[at], 0)]
            at = np.where(left[at] < 0, at, np.where(value <= threshold[at], left[at], right[at]))
        return at

    def scores(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """P(high quality) of each row, the mean of the trees' leaves."""
        p = self.columns["p"][self.leaves(x, depth)]
        total = np.zeros(len(x))
        for t in range(p.shape[1]):
            total += p[:, t]
        return total / float(p.shape[1])

    def score_column(self, spark: SparkSession, x_col: str):
        """``scores`` of a column of arrays of double."""
        shared, n_features, depth = spark.sparkContext.broadcast(self), 1 + int(self.columns["feature"].max(initial=0)), self.depth()

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            return pa.array(shared.value.scores(matrix(x, n_features)[0], depth))

        return score(F.col(x_col).cast("array<double>"))

    def _constants(self, column: int, kind: str) -> str:
        """A column of the nodes as a constant array, from one string that Spark folds away."""
        return constants([r[column] for r in self.rows], kind)

    def leaf_sql(self, x: str, tree: str) -> str:
        """The leaf that the features ``x`` (array of double) reach in ``tree``, as SQL: a fold over the levels.

        The nodes are constant arrays of the expression, so no row carries them.
        """
        feature, threshold, left, right = (self._constants(i, kind) for i, kind in ((2, "int"), (3, "double"), (4, "int"), (5, "int")))
        value = f"coalesce(get({x}, get({feature}, node)), double('NaN'))"
        onward = f"CASE WHEN get({left}, node) < 0 THEN node WHEN {value} <= get({threshold}, node) THEN get({left}, node) ELSE get({right}, node) END"
        return f"aggregate(sequence(1, {max(1, self.depth())}), int({tree}), (node, level) -> {onward})"

    def score_sql(self, x: str) -> str:
        """P(high quality), the mean of the trees' leaves, as SQL."""
        leaf = f"get({self._constants(6, 'double')}, {self.leaf_sql(x, 'tree')})"
        return f"aggregate(sequence(0, {self.trees - 1}), 0.0D, (total, tree) -> total + {leaf}) / {float(self.trees)}D"

    @classmethod
    def from_sql(cls, statement: str) -> TreeTable:
        """The nodes back from ``score_sql`` (without their numbers of rows)."""
        arrays = re.findall(r"split\('([^']*)', ','\) AS array<(\w+)>", statement)
        # In the order in which score_sql and leaf_sql name them.
        p, left, feature, threshold, _, right = [[(int if kind == "int" else float)(v) for v in text.split(",")] for text, kind in arrays]
        roots = set(range(len(p))) - {c for c in left + right if c >= 0}
        tree = {i: i for i in roots}
        for i in range(len(p)):  # a child's number is above its parent's
            for c in (left[i], right[i]):
                if c >= 0:
                    tree[c] = tree[i]
        return cls([(tree[i], i, feature[i], threshold[i], left[i], right[i], p[i], 0) for i in range(len(p))])


def constants(values: list, kind: str) -> str:
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS array<{kind}>)"


def matrix(x: pa.Array, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by features of a column of arrays, and how long each array is; what an array lacks, and null, is NaN."""
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = x.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    if (size == n_features).all():
        return values.reshape(len(size), n_features), size
    out = np.full((len(size), max(n_features, int(size.max(initial=0)))), np.nan)
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), place] = values
    return out[:, :n_features], size


class NodeForest(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Adds the score of a table of nodes for a column of arrays; saved with its nodes as a parquet table."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)
        self.table: TreeTable | None = None

    @classmethod
    def over(cls, table: TreeTable, input_col: str, output_col: str) -> NodeForest:
        out = cls(inputCol=input_col, outputCol=output_col)
        out.table = table
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.table.score_column(dataset.sparkSession, self.getInputCol()))

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader()


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table.frame(self.sparkSession).write.parquet(f"{path.rstrip('/')}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> NodeForest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = NodeForest()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.table = TreeTable.of(self.sparkSession.read.parquet(f"{path.rstrip('/')}/nodes"))
        return out


def score_by_joins(rows: DataFrame, nodes: DataFrame, id_col: str, x_col: str = "x") -> DataFrame:
    """(id, p_high) by walking the node rows with joins, a level at a time: the same scores in plain SQL."""
    table = TreeTable.of(nodes)
    at = rows.select(F.col(id_col).alias("id"), F.col(x_col).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(table.trees - 1))).alias("at"))
    joined = F.broadcast(nodes.select(F.col("node").alias("at"), "feature", "threshold", "left", "right"))  # a model's nodes: see MAX_NODES
    value = F.coalesce(F.get("x", F.col("feature")), F.lit(float("nan")))
    onward = F.when(F.col("left") < 0, F.col("at")).when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
    for _ in range(table.depth()):
        at = at.join(joined, "at").select("id", "x", onward.alias("at"))
    leaves = F.broadcast(nodes.select(F.col("node").alias("at"), "p"))
    return at.join(leaves, "at").groupBy("id").agg(F.avg("p").alias("p_high"))


def forest_nodes(spark: SparkSession, path: str) -> TreeTable:
    """The nodes of a saved pipeline whose last stage is a Spark ML forest."""
    stages = PipelineModel.load(path).stages
    data = spark.read.parquet(f"{path.rstrip('/')}/stages/{len(stages) - 1}_{stages[-1].uid}/data")
    node = F.col("nodeData")
    leaf = node["leftChild"] < 0
    stats = node["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, v: a + v)
    found = data.select(F.col("treeID").alias("tree"), node["id"].alias("id"), F.when(leaf, -1).otherwise(node["split"]["featureIndex"]).alias("feature"),
                        F.when(leaf, 0.0).otherwise(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
                        node["leftChild"].alias("left"), node["rightChild"].alias("right"), (F.get(stats, F.lit(1)) / total).alias("p"),
                        node["rawCount"].cast("long").alias("n")).toArrow()
    c = {name: found[name].to_numpy() for name in found.column_names}
    # Roots take the first numbers, all others follow, by tree and number in it.
    order = np.lexsort((c["id"], c["tree"], c["id"] != 0))
    c = {name: v[order] for name, v in c.items()}
    wide = 1 + int(c["id"].max())
    key = c["tree"].astype(np.int64) * wide + c["id"]
    by_key = np.argsort(key)

    def number(child: np.ndarray) -> np.ndarray:
        at = by_key[np.minimum(np.searchsorted(key, c["tree"].astype(np.int64) * wide + child, sorter=by_key), len(key) - 1)]
        return np.where(c["feature"] < 0, -1, at)

    tree = np.searchsorted(np.unique(c["tree"]), c["tree"])
    return TreeTable({"tree": tree, "node": np.arange(len(key)), "feature": c["feature"], "threshold": c["threshold"],
                      "left": number(c["left"]), "right": number(c["right"]), "p": c["p"], "n": c["n"]})


def fit_random_trees(rows: DataFrame, n_features: int, n_trees: int = 10, n_candidates: int = 2, seed: int = 0,
                     max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> TreeTable:
    """M8: extremely randomised trees over ``rows`` (x array of double, label 0/1), grown a level at a time.

    Every tree sees all rows. A node draws ``n_candidates`` of the features
    that differ inside it, and for each a threshold between their least and
    greatest value; the best of these (least Gini impurity) splits it. One
    aggregate a level finds, for the open nodes of all trees, the counts of
    both sides of every candidate and the ranges of the features there, which
    the next level draws from. Draws hang on the seed, the tree and the
    node's path alone, and counts and ranges are exact, so the same rows give
    the same trees however they are dealt.

    The driver holds the nodes only, as arrays, and a level's sums while it
    draws the next; tasks find the rows of open nodes by a broadcast of them.
    ``rows`` should be a stored table: each level reads it. An empty table
    gives trees of one leaf with p 0.
    """
    spark = rows.sparkSession
    x = F.transform(F.coalesce("x", F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(float("nan"))))
    rows = rows.select(x.alias("x"), F.col("label").cast("double").alias("label"))
    ranges = [f(F.get("x", F.lit(j))).alias(f"{name}{j}") for j in range(n_features) for name, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("pos"), *ranges).first()
    nodes = {"tree": array("i"), "feature": array("i"), "threshold": array("d"), "left": array("i"), "right": array("i"), "pos": array("d"), "n": array("q")}

    def add(tree: int, path: int, depth: int, n: int, pos: float, low: list, high: list) -> tuple[int, int, list]:
        """A new leaf: its number, its path and its candidates."""
        # Only features that differ and are known at both ends can part rows.
        candidates = []
        number = len(nodes["tree"])
        if 0 < pos < n and depth < max_depth and number + 2 < max_nodes:
            draw = random.Random(f"{seed}:{tree}:{path}")
            apart = [j for j in range(n_features) if low[j] is not None and high[j] is not None and low[j] < high[j]]
            for j in draw.sample(apart, min(n_candidates, len(apart))):
                cut = draw.uniform(low[j], high[j])
                candidates.append((j, cut if low[j] <= cut < high[j] else low[j]))
        for name, value in (("tree", tree), ("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("pos", pos), ("n", n)):
            nodes[name].append(value)
        return number, path, candidates

    sums = []
    for k in range(n_candidates):
        side = F.col(f"side{k}")
        sums += [F.count_if(side).alias(f"n{k}"), F.coalesce(F.sum(F.when(side, F.col("label"))), F.lit(0.0)).alias(f"pos{k}")]
        for j in range(n_features):
            v = F.get("x", F.lit(j))
            sums += [f(F.when(side if left else ~side, v)).alias(f"{name}{k}_{j}_{int(left)}") for left in (True, False) for name, f in (("lo", F.min), ("hi", F.max))]

    low, high = ([whole[f"{name}{j}"] for j in range(n_features)] for name in ("lo", "hi"))
    open_nodes, depth = [add(t, 1, 0, whole["n"], whole["pos"], low, high) for t in range(n_trees)], 0
    while open_nodes := [o for o in open_nodes if o[2]]:
        shared = spark.sparkContext.broadcast((_table(nodes), depth, *_asked(open_nodes, len(nodes["tree"]), n_candidates)))
        sides = rows.mapInArrow(_sides(shared, n_features, n_candidates), "x array<double>, label double, node int, " + ", ".join(f"side{k} boolean" for k in range(n_candidates)))
        found = sides.groupBy("node").agg(*sums).orderBy("node").toArrow()
        shared.unpersist()
        # Nulls (nothing known on that side) become NaN, which no feature is apart by.
        at = {c: found[c].to_numpy() for c in found.column_names}
        known, following, depth = {number: (path, candidates) for number, path, candidates in open_nodes}, [], depth + 1
        for i, number in enumerate(at["node"].tolist()):
            path, candidates = known[number]
            n_all, pos_all = nodes["n"][number], nodes["pos"][number]
            choices = []
            for k, (j, cut) in enumerate(candidates):
                left = (int(at[f"n{k}"][i]), float(at[f"pos{k}"][i]))
                right = (n_all - left[0], pos_all - left[1])
                if left[0] and right[0]:
                    choices.append((sum(2 * p * (n - p) / n for n, p in (left, right)), k, j, cut, left, right))
            if not choices:
                continue
            _, k, j, cut, left, right = min(choices)
            nodes["feature"][number], nodes["threshold"][number] = j, cut
            for name, is_left, (n, pos) in (("left", True, left), ("right", False, right)):
                low, high = ([float(at[f"{end}{k}_{f}_{int(is_left)}"][i]) for f in range(n_features)] for end in ("lo", "hi"))
                child = add(nodes["tree"][number], 2 * path + (not is_left), depth, n, pos, low, high)
                nodes[name][number] = child[0]
                following.append(child)
        open_nodes = following
    return _table(nodes)


def _asked(open_nodes: list[tuple[int, int, list]], size: int, n_candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of each candidate of each node."""
    feature, cut = np.full((n_candidates, size), -1, np.int32), np.zeros((n_candidates, size))
    for number, _, candidates in open_nodes:
        for k, (j, c) in enumerate(candidates):
            feature[k, number], cut[k, number] = j, c
    return feature, cut


def _sides(shared: Broadcast, n_features: int, n_candidates: int):
    """Task function: the rows of open nodes, once for each tree, with their node and the side of each candidate that they are on."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, depth, asked, cut = shared.value
        for batch in batches:
            x, size = matrix(batch.column("x"), n_features)
            at = table.leaves(x, depth)
            for tree in range(at.shape[1]):
                # A row that lacks the feature of the first candidate is on neither side.
                first = asked[0][at[:, tree]]
                row = np.nonzero((first >= 0) & (first < size))[0]
                node = at[row, tree]
                part = batch.take(pa.array(row))
                sides = []
                for k in range(n_candidates):
                    feature = asked[k][node]
                    sides.append(pa.array(x[row, np.maximum(feature, 0)] <= cut[k][node], mask=(feature < 0) | (feature >= size[row])))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("label"), pa.array(node, pa.int32()), *sides],
                                                 names=["x", "label", "node", *[f"side{k}" for k in range(n_candidates)]])

    return walk


def _table(nodes: dict[str, array]) -> TreeTable:
    c = {name: np.array(v) for name, v in nodes.items()}
    p = np.divide(c["pos"], c["n"], out=np.zeros(len(c["n"])), where=c["n"] > 0)
    return TreeTable({**{name: c[name] for name in ("tree", "feature", "threshold", "left", "right", "n")}, "node": np.arange(len(p)), "p": p})
