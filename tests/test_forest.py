"""Trees without a limit of levels, against plain Python and MLlib's own."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sieveline.operators import forest as W


def depth(nodes, at=0):
    deep, todo = 0, [(at, 0)]
    while todo:
        n, d = todo.pop()
        deep = max(deep, d)
        if nodes.feature[n] >= 0:
            todo += [(nodes.left[n], d + 1), (nodes.right[n], d + 1)]
    return deep


def chain(spark, n=72):
    """Rows that a split tells apart one at a time, so that any tree has about two thirds as many levels."""
    rows = [(i, Vectors.sparse(n, [i], [1.0]), float(i % 3), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "features", "label", "weight"])


def test_more_than_thirty_levels(spark):
    df = chain(spark)
    limited = RandomForestClassifier(numTrees=1, maxDepth=30, weightCol="weight", labelCol="label", seed=1).fit(df).transform(df)
    assert limited.filter("prediction != label").count() > 0
    model = W.DeepForest(trees=1, levels=4).fit(df)
    assert model.transform(df).filter("prediction != label").count() == 0
    (nodes,) = model.nodes
    assert max(depth(nodes, i) for i in range(model.top.trees[0].numNodes // 2 + 1)) + 4 > 40


@pytest.mark.parametrize("dense", [False, True])
def test_a_leaf_larger_than_a_task(spark, dense):
    """Samples of 20 a class grow it round by round until every row is told apart, whether its vectors are dense or sparse."""
    rows = []
    for i in range(600):
        x = [float(i % 7 - 3), float(i % 11) - 5, float(i)]
        rows.append((i, Vectors.dense(x) if dense else Vectors.sparse(3, {k: v for k, v in enumerate(x) if v}), float(hash((i * 7919) % 613) % 3), 1.0 + i % 2))
    df = spark.createDataFrame(rows, ["id", "features", "label", "weight"]).repartition(3)
    out = W.DeepForest(trees=1, levels=1, local=20).fit(df).transform(df)
    assert out.filter("prediction != label").count() == 0 and out.columns == [*df.columns, "votes", "prediction"]


def test_equal_rows_share_a_leaf(spark):
    """Rows that nothing tells apart vote by their weights; repeated ids and rows are fine."""
    rows = [(1, Vectors.dense([1.0, 0.0]), 0.0, 1.0)] * 3 + [(2, Vectors.dense([1.0, 0.0]), 1.0, 5.0), (3, Vectors.dense([0.0, 0.0]), 2.0, 1.0), (4, Vectors.dense([0.0, 1.0]), 0.0, 1.0)]
    df = spark.createDataFrame(rows, ["id", "features", "label", "weight"])
    got = {r["id"]: (r["prediction"], [round(v, 6) for v in r["votes"]]) for r in W.DeepForest(trees=1, levels=1).fit(df).transform(df).collect()}
    assert got == {1: (1.0, [0.375, 0.625, 0.0]), 2: (1.0, [0.375, 0.625, 0.0]), 3: (2.0, [0.0, 0.0, 1.0]), 4: (0.0, [1.0, 0.0, 0.0])}


def test_forest_learns_and_is_kept_in_bounds(spark, monkeypatch):
    """Held-out rows of a noisy rule; trees sent in several groups vote as those sent in one; a second fit agrees."""
    random = np.random.default_rng(3)
    x = random.normal(size=(900, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float) + (x[:, 2] > 1)
    df = spark.createDataFrame([(i, Vectors.dense(v), float(k), 1.0) for i, (v, k) in enumerate(zip(x.tolist(), y, strict=True))], ["id", "features", "label", "weight"]).repartition(2, "id").cache()
    train, test = df.filter("id < 600"), df.filter("id >= 600")
    model = W.DeepForest(trees=12, levels=3, at_once=5).fit(train)
    assert [len(n.base) for n in model.nodes] == [5, 5, 2]
    votes = lambda m: {r["id"]: [round(v, 9) for v in r["votes"]] for r in m.transform(test).select("id", "votes").collect()}
    one = votes(model)
    assert all(abs(sum(v) - 1) < 1e-6 for v in one.values())
    assert model.transform(test).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.7
    monkeypatch.setattr(W, "NODES_AT_ONCE", 1)
    assert len(model._groups()) == 3 and votes(model) == one
    assert votes(W.DeepForest(trees=12, levels=3, at_once=5).fit(train)) == one


def test_splits_by_definition():
    """The least Gini impurity among all thresholds of all features, over random small tables with zeros and negative values."""
    random = np.random.default_rng(5)
    for _ in range(200):
        n, d = int(random.integers(2, 12)), int(random.integers(1, 4))
        x, y, w = random.integers(-2, 3, (n, d)).astype(float), random.integers(0, 3, n), random.integers(1, 4, n).astype(float)
        row, index = np.nonzero(x)
        got = W.best_split(index, x[row, index], row, y, w, np.arange(n), 3) if len(row) else None

        def impurity(k, t):
            sides = [np.bincount(y[s], w[s], 3) for s in (x[:, k] <= t, x[:, k] > t)]  # noqa: B023
            return sum(s.sum() - (s * s).sum() / s.sum() for s in sides)

        every = [impurity(k, t) for k in range(d) for t in np.unique(x[:, k])[:-1]]
        assert (got is None) == (not every)
        if got:
            assert abs(impurity(*got) - min(every)) < 1e-9


def test_draws():
    drawn = W.draws(np.arange(20_000), 3, 4, False)
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(drawn.T)[0, 1]) < 0.03 and (W.draws(np.arange(3), 0, 2, True) == 1).all()


def test_a_large_node_looks_at_drawn_features_alone(monkeypatch):
    """Wide sparse rows: no node of many rows has all its entries looked through, and each leaf still ends pure."""
    random = np.random.default_rng(7)
    n, width = 400, 20_000
    index = [np.unique(random.integers(0, width, 300)) for _ in range(n)]
    row = np.repeat(np.arange(n), [len(i) for i in index])
    data, y, seen = W.Rows(row, np.concatenate(index), random.random(len(row))), random.integers(0, 3, n), []
    isin = np.isin
    monkeypatch.setattr(W.np, "isin", lambda a, b: seen.append(len(a)) or isin(a, b))
    nodes = W.Nodes(0, np.array([0]), width, *W.grow(data, y, np.ones(n), 3, width, 140, 1))
    at = nodes.places(np.zeros((n, 1), np.int64), data).ravel()
    assert all(len(np.unique(y[at == leaf])) == 1 for leaf in np.unique(at))
    assert max(seen, default=0) < len(row) / 10


@pytest.mark.parametrize("n, features, tried", [(40, 100, 10), (700, 20, 4), (300, 6, 6), (1, 3, 1)])
def test_full_rows_grow_the_same_tree_as_entries_do(monkeypatch, n, features, tried):
    """Vectors without gaps, as means of words are, are split by column, never by sorting entries."""
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, features)), 1)  # with ties, and zeros among the entries
    y, w = rng.integers(0, 3, n), rng.integers(1, 4, n).astype(float)
    data = W.Rows(np.repeat(np.arange(n), features), np.tile(np.arange(features), n), x.ravel())
    with monkeypatch.context() as m:
        m.setattr(W, "_matrix", lambda *_: None, raising=False)
        want = W.grow(data, y, w, 3, features, tried, 5)
    monkeypatch.setattr(W, "best_split", None)
    for got, expected in zip(W.grow(data, y, w, 3, features, tried, 5), want, strict=True):
        assert got.tolist() == expected.tolist()


def test_gathered_rows_are_sent_by_their_entries(monkeypatch):
    """Long texts' rows must not be sent thousands at a time."""
    import pyarrow as pa

    monkeypatch.setattr(W, "ENTRIES_AT_ONCE", 100, raising=False)
    sizes = [30, 0, 500, 3, 40, 60, 1]
    lists = lambda kind: pa.array([list(range(n)) for n in sizes], pa.list_(kind))
    n, trees = len(sizes), 4
    nodes = W.Nodes(0, np.arange(trees), 600, np.full(trees, -1, np.int32), np.zeros(trees), np.full(trees, -1, np.int32), np.full(trees, -1, np.int32))
    sent, rates = (type("Sent", (), {"value": v}) for v in (nodes, np.ones(trees * 2)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0, 1, 0, 1, 0, 1, 0], pa.int32()), pa.array([1.0] * n), pa.array([[0] * trees] * n, pa.list_(pa.int32())), lists(pa.int32()), lists(pa.float64())], ["key", "label", "weight", "leaves", "indices", "values"])
    got = list(W._gathered(sent, rates, 2, 1, True)(iter([batch])))
    assert all(b.num_rows == 1 or sum(map(len, b.column("indices").to_pylist())) <= 100 for b in got)
    assert sorted((b["node"].as_py(), b["key"].as_py(), len(b["values"])) for g in got for b in _rows(g)) == sorted((t, k, s) for t in range(trees) for k, s in enumerate(sizes))


def _rows(batch):
    return [{c: batch.column(c)[k] for c in ("node", "key", "values")} for k in range(batch.num_rows)]
