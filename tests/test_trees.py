"""Trees as tables: fitting against a plain version, scores by columns, by joins and by the fitted forest."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillrank.operators import trees as TR
from quillrank.plans import learning as L


def plain_trees(rows, n_features, n_trees, n_candidates, seed, max_depth=TR.MAX_DEPTH):
    """Leaves (tree, path, n, p) of the same rule, grown node by node."""
    out = set()

    def grow(tree, path, depth, members):
        n, pos = len(members), sum(y for _, y in members)
        draw = random.Random(f"{seed}:{tree}:{path}")
        apart = [j for j in range(n_features) if min(x[j] for x, _ in members) < max(x[j] for x, _ in members)] if members else []
        best = None
        if 0 < pos < n and depth < max_depth:
            for k, j in enumerate(draw.sample(apart, min(n_candidates, len(apart)))):
                low, high = min(x[j] for x, _ in members), max(x[j] for x, _ in members)
                cut = draw.uniform(low, high)
                cut = cut if low <= cut < high else low
                sides = [[m for m in members if (m[0][j] <= cut) == left] for left in (True, False)]
                impurity = sum(2 * sum(y for _, y in s) * (len(s) - sum(y for _, y in s)) / len(s) for s in sides)
                best = min(best, (impurity, k, sides), key=lambda b: b[:2]) if best else (impurity, k, sides)
        if best is None:
            out.add((tree, path, n, pos / n if n else 0.0))
        else:
            grow(tree, 2 * path, depth + 1, best[2][0])
            grow(tree, 2 * path + 1, depth + 1, best[2][1])

    for t in range(n_trees):
        grow(t, 1, 0, rows)
    return out


def leaves(table):
    found = set()

    def walk(node, path):
        tree, _, _, _, left, right, p, n = table.rows[node]
        if left < 0:
            found.add((tree, path, n, p))
        else:
            walk(left, 2 * path)
            walk(right, 2 * path + 1)

    for t in range(table.trees):
        walk(t, 1)
    return found


def sample(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.choice([0.0, 1.0, 2.0]), rng.random(), 5.0, float(rng.randrange(10))]
        rows.append((x, float(x[1] + 0.1 * x[3] + 0.3 * rng.random() > 0.9)))
    return rows


@pytest.mark.parametrize("depth", [30, 2])
def test_random_trees_against_a_plain_version(spark, depth):
    rows = sample()
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "id long, x array<double>, label double")
    one = TR.fit_random_trees(df.repartition(1), 4, n_trees=3, seed=5, max_depth=depth)
    assert leaves(one) == plain_trees(rows, 4, 3, 2, 5, depth)
    other = TR.fit_random_trees(df.repartition(5), 4, n_trees=3, seed=5, max_depth=depth)
    assert one.rows == other.rows
    assert TR.fit_random_trees(df, 4, n_trees=3, seed=6, max_depth=depth).rows != one.rows
    assert one.depth() <= depth and (depth == 2 or all(p in (0.0, 1.0) for _, _, _, p in leaves(one)))


def test_scores_by_columns_and_by_joins(spark, tmp_path):
    rows = sample()
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "id long, x array<double>, label double")
    table = TR.fit_random_trees(df, 4, n_trees=4, seed=2, max_depth=5)
    table.frame(spark).write.parquet(str(tmp_path / "nodes"))
    stored = TR.TreeTable.of(spark.read.parquet(str(tmp_path / "nodes")))
    assert stored.rows == table.rows
    more = df.union(spark.createDataFrame([(900, [None, float("nan"), 5.0, 1.0], 0.0), (901, [float("inf")] * 4, 0.0), (902, None, 0.0)], df.schema))
    assert [r[:7] for r in TR.TreeTable.from_sql(stored.score_sql("x")).rows] == [r[:7] for r in table.rows]
    a = {r.id: r.p for r in more.select("id", F.expr(stored.score_sql("x")).alias("p")).collect()}
    b = {r.id: r.p_high for r in TR.score_by_joins(more, table.frame(spark), "id").collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], abs_tol=1e-12) for i in a)

    def plain(x):
        total = 0.0
        for node in range(table.trees):
            while table.rows[node][4] >= 0:
                _, _, f, cut, left, right, _, _ = table.rows[node]
                v = x[f] if x and x[f] is not None else math.nan
                node = left if v <= cut else right
            total += table.rows[node][6]
        return total / table.trees

    assert all(math.isclose(a[r.id], plain(r.x), abs_tol=1e-12) for r in more.collect())


def test_nothing_to_split(spark):
    schema = "x array<double>, label double"
    for rows in ([], [([1.0, 2.0], 1.0)], [([1.0, 2.0], 0.0), ([1.0, 2.0], 1.0)], [(None, 1.0), (None, 0.0)], [([float("nan"), 1.0], 1.0), ([float("nan"), 1.0], 0.0)]):
        table = TR.fit_random_trees(spark.createDataFrame(rows, schema), 2, n_trees=2)
        assert len(table.rows) == 2 and table.depth() == 0
        assert all(r[6] == (sum(y for _, y in rows) / len(rows) if rows else 0.0) for r in table.rows)


def test_a_saved_forest_scores_as_its_nodes(spark, tmp_path):
    rows = [(i, i, bool(y), not y, *x, 1.0, 1.0) for i, (x, y) in enumerate(sample(200))]
    t = spark.createDataFrame(rows, "id long, pageId long, featured boolean, flagged boolean, a double, b double, c double, d double, meanWordLength double, reading_ease double")
    qm, _ = L.fit_models(t, ["a", "b", "d"], discretize={"a": True, "b": False, "d": True}, kinds=("rf", "xtrees", "logreg"))
    for kind in ("rf", "xtrees", "logreg"):
        path = str(tmp_path / kind)
        model = qm.models[kind]
        scored = {r.id: r.p_high for r in L.probability(model, t).select("id", "p_high").collect()}
        L.save_model(model, path)
        again = {r.id: r.p for r in t.join(L.stored_scores(spark, path, t), "id").select("id", F.col("p_stored").alias("p")).collect()}
        assert scored.keys() == again.keys() and all(math.isclose(scored[i], again[i], abs_tol=1e-9) for i in scored)
        assert len(set(scored.values())) > 5


def test_a_model_of_many_nodes_stays_out_of_plans(spark, tmp_path):
    """Nodes are handed to tasks beside the plan: neither the fit nor a stored model's score writes them into a statement."""
    rng = random.Random(3)
    rows = [(i, i, y, not y, rng.random(), rng.random(), 1.0, 1.0) for i, y in ((i, rng.random() < 0.5) for i in range(1500))]
    t = spark.createDataFrame(rows, "id long, pageId long, featured boolean, flagged boolean, a double, b double, meanWordLength double, reading_ease double")
    qm, _ = L.fit_models(t, ["a", "b"], discretize={"a": True, "b": False}, kinds=("xtrees", "rf"))
    for kind, model in qm.models.items():
        path = str(tmp_path / kind)
        L.save_model(model, path)
        scored = L.probability(L.load_model(path), t)
        stored = L.stored_scores(spark, path, t)
        for df in (scored, stored):
            assert not re.search(r"(?:[-.e\d]+,\s*){50}", df._jdf.queryExecution().toString())
        a = {r.id: r.p_high for r in scored.select("id", "p_high").collect()}
        b = {r.id: r.p_stored for r in stored.collect()}
        assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], abs_tol=1e-9) for i in a)
    table = qm.models["xtrees"].stages[-2].table
    assert len(table.rows) > 2000 and TR.TreeTable.of(table.frame(spark)).rows == table.rows


def test_nodes_beyond_the_bound_are_leaves(spark):
    rows = sample(300)
    df = spark.createDataFrame([(x, y) for x, y in rows] + [([0.5], 1.0), (None, 0.0)], "x array<double>, label double")
    whole, cut = TR.fit_random_trees(df, 4, n_trees=2), TR.fit_random_trees(df, 4, n_trees=2, max_nodes=20)
    assert len(cut.rows) < len(whole.rows) and all(r[4] < 0 for r in cut.rows[18:])
    assert [r[2:6] for r in cut.rows[:18]] == [r[2:6] for r in whole.rows[:18]]
