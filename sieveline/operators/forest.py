"""Forests whose trees have no limit of levels.

MLlib grows the tops of all trees from statistics of all rows. What a top's leaf leaves mixed is grown on until it is
pure or its rows can't be told apart: rows are gathered by leaf, and each leaf becomes a subtree in a task of its own.
Of a leaf with very many rows about LOCAL a class are gathered; then all of its rows go down the subtree, and what is
still mixed is grown on in the next round, unless the gathered rows were all equal. So no task holds more than some thousand rows, whatever a leaf holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import clear, new_path

#: Rows of a class that are gathered of a leaf, about.
LOCAL = 2_000
#: Trees that are grown on in one pass over the rows.
TREES_AT_ONCE = 50
#: Nodes, of 20 bytes and a share of each class, that are sent to a task at once unless one tree has more.
NODES_AT_ONCE = 5_000_000
#: Rows that go down the trees together.
ROWS_AT_ONCE = 1_000
#: Entries that a task sends together when rows are gathered, unless one row has more.
ENTRIES_AT_ONCE = 1_000_000

_SPLIT = "node int, feature array<int>, threshold array<double>, left array<int>, right array<int>"


@dataclass
class Nodes:
    """Some trees below their tops: the first nodes of each are the leaves of its top. A node without a feature (-1) is a leaf; a row goes left whose value is the threshold at most."""

    first: int  # of the trees
    base: np.ndarray  # where the nodes of each tree's top begin
    width: int  # of the vectors
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray | None = None  # of the classes, at leaves

    def put(self, node: int, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Puts a subtree, whose root is its first node, in place of a leaf."""
        n = len(self.feature)
        below = lambda c: np.where(c < 0, -1, c + n - 1)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature[0], threshold[0], below(left[0]), below(right[0])
        for name, more in (("feature", feature), ("threshold", threshold), ("left", below(left)), ("right", below(right))):
            setattr(self, name, np.concatenate([getattr(self, name), more[1:].astype(getattr(self, name).dtype)]))

    def places(self, leaves: np.ndarray, rows: Rows) -> np.ndarray:
        """The leaf of each row (down) in each tree (across), given its leaf in each top."""
        n, trees = leaves.shape
        at = (self.base[None, :] + leaves).ravel()
        row = np.repeat(np.arange(n, dtype=np.int64), trees)
        keys = np.append(rows.row.astype(np.int64) * self.width + rows.index, np.iinfo(np.int64).max)
        values = np.append(rows.value, 0.0)
        moving = np.flatnonzero(self.feature[at] >= 0)
        while moving.size:
            here = at[moving]
            wanted = row[moving] * self.width + self.feature[here]
            found = np.searchsorted(keys, wanted)
            x = np.where(keys[found] == wanted, values[found], 0.0)
            at[moving] = np.where(x <= self.threshold[here], self.left[here], self.right[here])
            moving = moving[self.feature[at[moving]] >= 0]
        return at.reshape(n, trees)


@dataclass
class Rows:
    """Vectors as entries (row, index, value), by row and index."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _lists(of: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values one after the other) of lists, none of a null."""
    return of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), of.flatten().to_numpy(zero_copy_only=False)


def entries(indices: pa.ListArray, values: pa.ListArray) -> Rows:
    n, value = _lists(values)
    return Rows(np.repeat(np.arange(len(n), dtype=np.int32), n), _lists(indices)[1].astype(np.int32, copy=False), value.astype(np.float64, copy=False))


def sparse(vectors: pa.StructArray) -> tuple[pa.ListArray, pa.ListArray]:
    """(indices, values) of a column of vectors; a dense one has all indices."""
    kind, _, indices, values = vectors.flatten()
    if not pa.compute.any(pa.compute.equal(kind, 1)).as_py():
        return indices, values
    each = [np.arange(len(v), dtype=np.int32) if k == 1 else i for k, i, v in zip(kind.to_pylist(), indices.to_pylist(), values.to_pylist(), strict=True)]
    return pa.array(each, pa.list_(pa.int32())), values


def uniform(key: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Numbers from 0 to 1 that hang on a row's key and a salt only, so that a task that is run again draws them again."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + (np.asarray(salt, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def draws(key: np.ndarray, first: int, trees: int, whole: bool) -> np.ndarray:
    """How often each row (down) is in each tree's sample with replacement (across), as counts with a mean of one; whole: once each."""
    if whole:
        return np.ones((len(key), trees), np.int64)
    chances = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(16), 1.0)))
    return np.searchsorted(chances, uniform(key[:, None], np.arange(first, first + trees)[None, :]), side="right")


def best_split(slot: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, classes: int) -> tuple[int, float] | None:
    """(slot, threshold) with the least Gini impurity among entries of features by slot, whose other rows have 0; None where each slot has one value."""
    slots, slot = np.unique(slot, return_inverse=True)
    total = np.bincount(y[rows], w[rows], classes)
    held = np.bincount(slot * classes + y[row], w[row], len(slots) * classes).reshape(-1, classes)
    bare = np.flatnonzero(np.bincount(slot, minlength=len(slots)) < len(rows))  # these have rows without an entry
    mass = np.zeros((len(slot) + len(bare), classes))
    mass[np.arange(len(slot)), y[row]] = w[row]
    mass[len(slot) :] = np.maximum(total - held[bare], 0.0)
    slot, value = np.concatenate([slot, bare]), np.concatenate([value, np.zeros(len(bare))])
    order = np.lexsort((value, slot))
    slot, value, mass = slot[order], value[order], mass[order]
    run = np.cumsum(mass, axis=0)
    starts = np.searchsorted(slot, np.arange(len(slots)))
    before = np.concatenate([np.zeros((1, classes)), run])[starts]
    cut = np.flatnonzero((slot[1:] == slot[:-1]) & (value[1:] > value[:-1]))
    if not cut.size:
        return None
    low = run[cut] - before[slot[cut]]
    high = np.maximum(total - low, 0.0)
    pure = lambda m: (m * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-300)
    best = cut[int(np.argmax(pure(low) + pure(high)))]
    middle = (value[best] + value[best + 1]) / 2
    return int(slots[slot[best]]), float(middle if middle < value[best + 1] else value[best])


def _runs(starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The places of the chosen runs, which begin at starts, one run after the other."""
    n = starts[chosen + 1] - starts[chosen]
    return np.arange(int(n.sum())) + np.repeat(starts[chosen] - (np.cumsum(n) - n), n)


def _matrix(data: Rows, rows: int, held: np.ndarray) -> np.ndarray | None:
    """The values (rows, features held) where each row has an entry of each feature; else None."""
    return data.value.reshape(rows, len(held)) if len(held) and len(data.value) == rows * len(held) else None


def best_column(values: np.ndarray, mass: np.ndarray) -> tuple[int, float] | None:
    """`best_split` among columns of (rows, features), all of them sorted at once; mass: each row's weight in the column of its class."""
    order = np.argsort(values, axis=0, kind="stable")
    own = np.take_along_axis(values, order, axis=0)
    cut = own[1:] > own[:-1]
    if not cut.any():
        return None
    low = np.cumsum(mass[order], axis=0)[:-1]
    high = np.maximum(mass.sum(axis=0) - low, 0.0)
    pure = lambda m: np.einsum("rfc,rfc->rf", m, m) / np.maximum(m.sum(axis=2), 1e-300)
    gain = np.where(cut, pure(low) + pure(high), -np.inf)
    column, at = divmod(int(np.argmax(gain.T)), len(gain))  # by column, then by value, as `best_split` goes
    middle = (own[at, column] + own[at + 1, column]) / 2
    return column, float(middle if middle < own[at + 1, column] else own[at, column])


def grow(data: Rows, y: np.ndarray, w: np.ndarray, classes: int, width: int, tried: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, left, right) of a tree until each leaf is pure or all its rows are equal.

    At each node `tried` of all features are drawn, and those that have a value there are tried, one at least, and more
    until one of them splits. The entries are held by row and by feature. A node of many rows looks at those of the
    drawn features alone, a node of few rows at its rows' own, whichever are fewer. Where every row has every feature,
    entries are a matrix, of which a node takes its rows and the drawn columns: the same draws and splits at less cost.
    """
    random = np.random.default_rng(seed)
    feature, threshold, left, right = [-1], [0.0], [-1], [-1]
    by_row = np.searchsorted(data.row, np.arange(len(y) + 1))
    order = np.argsort(data.index, kind="stable")
    held, starts = np.unique(data.index[order], return_index=True)
    by_feature = np.append(starts, len(order))
    inside, x = np.zeros(len(y), bool), np.zeros(len(y))
    matrix = _matrix(data, len(y), held)
    mass = np.zeros((len(y), classes))
    mass[np.arange(len(y)), y] = w

    def of_columns(rows: np.ndarray, chosen: np.ndarray) -> tuple[int, float] | None:
        columns = np.sort(chosen)
        best = best_column(matrix[rows[:, None], columns], mass[rows])
        return best and (int(held[columns[best[0]]]), best[1])

    todo = [(0, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        if not len(held) or np.all(y[rows] == y[rows[0]]):
            continue
        found, drawn = None, int(random.binomial(tried, min(1.0, len(held) / width)))
        if drawn * (len(order) / len(held)) < int((by_row[rows + 1] - by_row[rows]).sum()):
            chosen = random.choice(len(held), drawn, replace=False, shuffle=False)
            if matrix is not None:
                found = of_columns(rows, chosen) if drawn else None
            else:
                at = order[_runs(by_feature, chosen)]
                inside[rows] = True
                at = at[inside[data.row[at]]]
                inside[rows] = False
                found = best_split(data.index[at], data.value[at], data.row[at], y, w, rows, classes) if at.size else None
            drawn = 0
        if found is None:
            if matrix is None:
                own = _runs(by_row, rows)
                here = data.index[own]
            present = random.permutation(held if matrix is not None else np.unique(here))
            begin, end = 0, max(1, int(random.binomial(drawn, len(present) / len(held))))
            while found is None and begin < len(present):
                if matrix is not None:
                    found = of_columns(rows, np.searchsorted(held, present[begin:end]))
                else:
                    at = own[np.isin(here, present[begin:end])]
                    found = best_split(data.index[at], data.value[at], data.row[at], y, w, rows, classes)
                begin, end = end, 2 * end
        if found is None:
            continue
        k = int(np.searchsorted(held, found[0]))
        if matrix is not None:
            lower = matrix[rows, k] <= found[1]
        else:
            at = order[by_feature[k] : by_feature[k + 1]]
            x[data.row[at]] = data.value[at]
            lower = x[rows] <= found[1]
            x[data.row[at]] = 0.0
        feature[node], threshold[node] = found
        for side, below in ((left, lower), (right, ~lower)):
            side[node] = len(feature)
            feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1)
            todo.append((side[node], rows[below]))
    return np.array(feature), np.array(threshold), np.array(left), np.array(right)


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches one after the other, in each of which sizes add up to `most` at most, or that have one member."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def _leaves(column: pa.ListArray, first: int, trees: int) -> np.ndarray:
    return _lists(column)[1].reshape(len(column), -1)[:, first : first + trees].astype(np.int64)


def _counted(sent: Broadcast, classes: int, whole: bool) -> Callable:
    """Rows to (node, label, weight in the sample, weight, rows in the sample), added up in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: Nodes = sent.value
        for part in _parts(batches):
            key, label, weight, leaves, indices, values = part.columns
            at = nodes.places(_leaves(leaves, nodes.first, len(nodes.base)), entries(indices, values))
            drawn = draws(key.to_numpy(), nodes.first, len(nodes.base), whole)
            w = weight.to_numpy()[:, None]
            cells, cell = np.unique(at * classes + label.to_numpy()[:, None], return_inverse=True)
            total = lambda x: np.bincount(cell.ravel(), np.broadcast_to(x, at.shape).ravel(), len(cells))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(cells // classes), pa.array((cells % classes).astype(np.int32)), pa.array(total(w * drawn)), pa.array(total(w)), pa.array(total(drawn > 0).astype(np.int64))], ["node", "label", "drawn", "weight", "n"])

    return run


def _gathered(sent: Broadcast, rates: Broadcast, classes: int, salt: int, whole: bool) -> Callable:
    """Rows to (node, key, label, weight, indices, values) for each node that is grown on, at the rates of its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: Nodes = sent.value
        for part in _parts(batches):
            key, label, weight, leaves, indices, values = part.columns
            trees = len(nodes.base)
            at = nodes.places(_leaves(leaves, nodes.first, trees), entries(indices, values))
            drawn = draws(key.to_numpy(), nodes.first, trees, whole)
            rate = rates.value[at * classes + label.to_numpy()[:, None]]
            chance = uniform(key.to_numpy()[:, None], (np.arange(trees) + nodes.first + (salt << 32))[None, :])
            row, tree = np.nonzero((drawn > 0) & (chance < rate))
            for i, j in _stretches(1 + _lists(indices)[0][row], ENTRIES_AT_ONCE):
                r, t = row[i:j], tree[i:j]
                taken = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(at[r, t].astype(np.int32)), key.take(taken), label.take(taken), pa.array(weight.to_numpy()[r] * drawn[r, t] / rate[r, t]), indices.take(taken), values.take(taken)], ["node", "key", "label", "weight", "indices", "values"])

    return run


def _flat(rows: DataFrame) -> DataFrame:
    """(key, label, weight, leaves, indices, values) of (key, label, weight, leaves, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, vectors = batch.columns
            yield pa.RecordBatch.from_arrays([*others, *sparse(vectors)], ["key", "label", "weight", "leaves", "indices", "values"])

    return rows.mapInArrow(run, "key long, label int, weight double, leaves array<int>, indices array<int>, values array<double>")


class DeepForest:
    """Trees of a forest without a limit of levels, from (id, features, label, weight); labels are 0, 1 and so on, ids tell rows apart.

    levels: of the tops that MLlib grows. Below a top a tree has a sample with replacement of its own, drawn by id.
    One tree alone takes each row once and tries every feature. A table without rows is an error, as it is for MLlib.
    """

    def __init__(self, trees: int = 200, levels: int = 8, local: int = LOCAL, at_once: int = TREES_AT_ONCE, seed: int = 42):
        self.trees, self.levels, self.local, self.at_once, self.seed = trees, levels, local, at_once, seed

    def fit(self, df: DataFrame) -> DeepForestModel:
        top = RandomForestClassifier(numTrees=self.trees, maxDepth=self.levels, weightCol="weight", labelCol="label", seed=self.seed, leafCol="leaf").fit(df)
        spark = df.sparkSession
        path = new_path(spark, "forest")
        leaves = vector_to_array("leaf").cast("array<int>")
        _flat(top.transform(df).select(F.xxhash64("id").alias("key"), F.col("label").cast("int"), F.col("weight").cast("double"), leaves.alias("leaves"), "features")).write.parquet(path)
        rows = spark.read.parquet(path)
        tops = [r["n"] for r in rows.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree").agg((F.max("leaf") + 1).alias("n")).orderBy("tree").collect()]
        done = [self._grown(rows, tops, first, top.numFeatures, top.numClasses) for first in range(0, self.trees, self.at_once)]
        clear(spark, [path])
        return DeepForestModel(top, done)

    def _grown(self, rows: DataFrame, tops: list[int], first: int, width: int, classes: int) -> Nodes:
        sizes = np.array(tops[first : first + self.at_once])
        n = int(sizes.sum())
        nodes = Nodes(first, np.cumsum(sizes) - sizes, width, np.full(n, -1, np.int32), np.zeros(n), np.full(n, -1, np.int32), np.full(n, -1, np.int32))
        sc = rows.sparkSession.sparkContext
        whole = self.trees == 1
        tried = width if whole else max(1, int(np.sqrt(width)))
        closed = np.zeros(n, bool)
        salt = 0
        while True:
            sent = sc.broadcast(nodes)
            drawn, weight, held = (np.zeros(len(nodes.feature) * classes) for _ in range(3))
            counted = rows.mapInArrow(_counted(sent, classes, whole), "node long, label int, drawn double, weight double, n long")
            found = counted.groupBy("node", "label").agg(*[F.sum(c).alias(c) for c in ("drawn", "weight", "n")]).toPandas()
            cell = (found["node"] * classes + found["label"]).to_numpy()
            drawn[cell], weight[cell], held[cell] = found["drawn"], found["weight"], found["n"]
            mixed = ((held.reshape(-1, classes) > 0).sum(axis=1) > 1) & ~closed
            if not mixed.any():
                sent.unpersist()
                break
            rate = np.where(np.repeat(mixed, classes), np.minimum(1.0, self.local / np.maximum(held, 1.0)), 0.0)
            rates = sc.broadcast(rate)
            salt += 1
            gathered = rows.mapInArrow(_gathered(sent, rates, classes, salt, whole), "node int, key long, label int, weight double, indices array<int>, values array<double>")
            split = gathered.groupBy("node").applyInArrow(_subtree(classes, width, tried, self.seed + (first << 16)), _SPLIT).toPandas()
            sampled = (rate.reshape(-1, classes) < 1.0) & (held.reshape(-1, classes) > 0)
            for s in split.sort_values("node").itertuples(index=False):
                nodes.put(s.node, *(np.asarray(x) for x in (s.feature, s.threshold, s.left, s.right)))
                # what all rows made is done; what a sample made is looked at anew, unless its rows were all equal
                done = not sampled[s.node].any() or len(s.feature) == 1
                closed[s.node] |= done
                closed = np.concatenate([closed, np.full(len(s.feature) - 1, done)])
            sent.unpersist()
            rates.unpersist()
        shares = np.where(drawn.reshape(-1, classes).sum(axis=1, keepdims=True) > 0, drawn.reshape(-1, classes), weight.reshape(-1, classes))
        nodes.shares = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        return nodes


def _subtree(classes: int, width: int, tried: int, seed: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("key", "label", "weight")]).combine_chunks()  # however rows arrive
        node = key[0].as_py()
        indices, values = (_chunk(rows[c]) for c in ("indices", "values"))
        grown = grow(entries(indices, values), rows["label"].to_numpy(), rows["weight"].to_numpy(), classes, width, tried, seed + node)
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32())
        return pa.table({"node": pa.array([node], pa.int32()), **{c: pa.array([x], pa.list_(t)) for c, x, t in zip(("feature", "threshold", "left", "right"), grown, kinds, strict=True)}})

    return run


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


class DeepForestModel:
    """Tops and what is below them. `transform` adds votes (a share of each class) and prediction; each tree has one vote."""

    def __init__(self, top: RandomForestClassificationModel, nodes: list[Nodes]):
        self.top, self.nodes = top, nodes

    def _groups(self) -> list[list[Nodes]]:
        groups: list[list[Nodes]] = []
        for n in self.nodes:
            if not groups or sum(len(m.feature) for m in (*groups[-1], n)) > NODES_AT_ONCE:
                groups.append([])
            groups[-1].append(n)
        return groups

    def transform(self, df: DataFrame) -> DataFrame:
        classes, names = self.top.numClasses, df.columns
        at = df.columns.index("features")
        out = self.top.transform(df).select(*names, vector_to_array("leaf").cast("array<int>").alias("leaves"), F.array_repeat(F.lit(0.0), classes).alias("votes"))
        for i, group in enumerate(self._groups()):
            out = out.checkpoint() if i else out  # so that one group of trees is in a task's memory at a time
            out = out.mapInArrow(_voted(df.sparkSession.sparkContext.broadcast(group), at, classes), out.schema)
        votes = F.transform("votes", lambda v: v / F.lit(float(self.top.getNumTrees)))
        return out.select(*names, votes.alias("votes")).withColumn("prediction", (F.array_position("votes", F.array_max("votes")) - 1).cast("double"))


def _voted(sent: Broadcast, at: int, classes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            *others, leaves, votes = part.columns
            votes = _lists(votes)[1].reshape(-1, classes).copy()
            data = entries(*sparse(others[at]))
            for nodes in sent.value:
                votes += nodes.shares[nodes.places(_leaves(leaves, nodes.first, len(nodes.base)), data)].sum(axis=1)
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1, dtype=np.int32) * classes), pa.array(votes.ravel()))
            yield pa.RecordBatch.from_arrays([*others, leaves, total.cast(part.schema.field("votes").type)], schema=part.schema)

    return run
