"""Word vectors: a step by definition, n-grams, what training over several tasks finds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import embeddings as V
from sieveline.operators import ml


def naive(inputs, outputs, rows, context, target, rate, reach):
    """The same step, position by position, from the tables before it."""
    a, b = inputs.astype(float).copy(), outputs.astype(float).copy()
    own = lambda w: rows.places[rows.starts[w] : rows.starts[w + 1]]
    for around, ts in zip(context, target, strict=True):
        words = [w for w in around if w >= 0]
        h = sum((inputs[own(w)].astype(float).mean(axis=0) for w in words), np.zeros(inputs.shape[1])) / max(1, len(words))
        back = np.zeros(inputs.shape[1])
        for k, t in enumerate(ts):
            if k and t == ts[0]:
                continue
            g = rate * ((k == 0) - 1 / (1 + math.exp(-float(h @ outputs[t]))))
            back += g * outputs[t]
            b[t] += g * h
        for w in words:
            for p in own(w):
                a[p] += back
    for new, old in ((a, inputs), (b, outputs)):
        for k in range(len(new)):
            size = np.linalg.norm(new[k] - old[k])
            if size > reach:
                new[k] = old[k] + (new[k] - old[k]) * reach / size
    return a, b


@pytest.mark.parametrize("reach", [1e9, 0.2])
@pytest.mark.parametrize("buckets", [0, 7])
def test_a_step_by_definition(buckets, reach):
    rng = np.random.default_rng(1)
    words = ["aa", "abc", "b", "bcd", "zzzz"]
    rows = V.Rows.of(words, buckets)
    inputs, outputs = rng.normal(size=(5 + buckets, 6)), rng.normal(size=(5, 6))
    context = np.array([[0, 1, -1, -1], [1, 1, 2, 4], [-1, -1, -1, 3], [-1, -1, -1, -1]])
    target = np.array([[2, 0, 1], [3, 3, 4], [4, 0, 0], [1, 2, 3]])
    want = naive(inputs, outputs, rows, context, target, 0.3, reach)
    got = inputs.copy(), outputs.copy()
    seen = V.step(*got, rows, context, target, 0.3, reach)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    assert (np.abs(got[0] - inputs).sum(axis=1) > 0)[seen[0] == 0].sum() == 0 and (np.abs(got[1] - outputs).sum(axis=1) > 0)[seen[1] == 0].sum() == 0


def test_windows_and_grams():
    assert V.windows(np.array([5, 6, 7]), np.array([1, 2, 1]), 2).tolist() == [[-1, -1, 6, -1], [-1, 5, 7, -1], [-1, 6, -1, -1]]
    assert V.grams_of("ab", (3, 6)) == ["<ab", "ab>"] and V.grams_of("", (3, 6)) == []
    rows = V.Rows.of(["ab", "c"], 4)
    flat, owner, n = rows.flat(np.array([1, 0, 1]))
    assert n.tolist() == [1, 3, 1] and owner.tolist() == [0, 1, 1, 1, 2] and flat[0] == 1 and flat[1] == 0 and all(2 <= p < 6 for p in flat[2:4])


TOPICS = {"bank": "account verify transfer balance branch".split(), "food": "dinner pizza salad kitchen supper".split(), "sport": "goal match league player stadium".split()}


def texts(spark, n=900):
    rnd = random.Random(2)
    rows = []
    for k in range(n):
        topic = list(TOPICS.values())[k % 3]
        rows.append((k, [rnd.choice(topic) for _ in range(12)] + [f"w{rnd.randrange(40)}"]))
    return spark.createDataFrame(rows, "id long, words array<string>")


def near(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("buckets", [0, 2048])
def test_words_used_alike_lie_near(spark, buckets):
    """Six tasks, whose tables are averaged."""
    got = V.learn(texts(spark), dimensions=24, buckets=buckets, passes=4, texts_a_task=150)
    v = got.word
    inside = np.mean([near(v(a), v(b)) for t in TOPICS.values() for a in t for b in t if a < b])
    across = np.mean([near(v(a), v(b)) for a in TOPICS["bank"] for b in TOPICS["food"] + TOPICS["sport"]])
    assert inside > across + 0.3
    again = V.learn(texts(spark).repartition(5), dimensions=24, buckets=buckets, passes=4, texts_a_task=150)
    assert again.words == got.words and np.allclose(again.table, got.table, atol=1e-4)


def test_misspelt_words_lie_near_their_originals(spark):
    got = V.learn(texts(spark), dimensions=24, buckets=4096, passes=4, texts_a_task=150)
    for misspelt, original in (("acount", "account"), ("kitchenn", "kitchen"), ("stadiun", "stadium")):
        others = [w for t in TOPICS.values() if original not in t for w in t]
        assert near(got.word(misspelt), got.word(original)) > max(near(got.word(misspelt), got.word(w)) for w in others)
    plain = V.learn(texts(spark), dimensions=8, passes=1)
    assert plain.word("acount") is None and not plain.text(["acount"]).any() and not plain.text(None).any()
    assert np.allclose(plain.text(["acount", "pizza", "goal"]), (plain.word("pizza") + plain.word("goal")) / 2)


def test_whole_documents_stay_in_reach(spark):
    """Frequent words and n-grams of real texts, which thousands of positions of a batch share."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.split(F.lower("text"), r"\s+").alias("words"))
    for buckets in (0, 1 << 12):
        got = V.learn(rows, dimensions=16, buckets=buckets, passes=3, texts_a_task=50)
        size = np.linalg.norm(got.table, axis=1)
        assert np.isfinite(size).all() and 0.05 < np.median(size[: len(got.words)]) and size.max() < 50


def test_no_words(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, ["", None, "once"])], "id long, words array<string>")
    got = V.learn(rows, dimensions=4)
    assert got.words == () and V.with_vectors(rows, got, "words", "features").select("features").distinct().count() == 1


def test_texts_are_dealt_to_tasks(spark):
    sizes = [r["n"] for r in V.dealt(texts(spark), "words", 150).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and sum(sizes) == 900 and max(sizes) < 250


@pytest.mark.parametrize("encoder", ["w2v", "fasttext"])
def test_encoders_are_dense(spark, encoder):
    rows = texts(spark, 60).select("id", F.array_join("words", " ").alias("text"))
    out = ml.Pipeline(stages=ml.ENCODERS[encoder](10, 1)).fit(rows).transform(rows)
    assert {len(r["features"]) for r in out.select("features").collect()} == {10} and ml.DIMENSIONS == 100


def test_more_texts_are_no_more_tasks(spark):
    """What a pass moves is bounded by the tasks, each of which sends back the rows it changed."""
    dealt = V.dealt(texts(spark), "words", 2)
    assert dealt.rdd.getNumPartitions() == V.TASKS and dealt.count() == 900
    got = V.learn(texts(spark), dimensions=8, passes=2, texts_a_task=7)  # several helpings a task
    assert np.isfinite(got.table).all() and (got.table != 0).all(axis=1).all()


def test_runs_are_added_up():
    """Runs of one member, of as many as are added up together, and longer ones."""
    rng = np.random.default_rng(3)
    place = rng.permutation(np.repeat([2, 5, 7, 9, 11], [1, V.RUN, V.RUN + 1, 3 * V.RUN, 2]))
    values = rng.normal(size=(len(place), 3))
    own, order, first, n = V._runs(place)
    assert own.tolist() == [2, 5, 7, 9, 11] and n.tolist() == [1, V.RUN, V.RUN + 1, 3 * V.RUN, 2]
    assert np.allclose(V._summed(values, order, first, n), [values[place == k].sum(axis=0) for k in own])
    none = V._runs(place[:0])
    assert V._summed(values, none[1], none[2], none[3]).shape == (0, 3)


def test_rows_of_tasks_are_averaged_in_parts():
    """A row's vectors may lie in two parts of a batch, or in two batches; what a row is made of is not looked at one by one."""
    row = np.repeat(np.arange(50), np.r_[np.ones(25, int), np.full(25, 400)])
    n, kind = np.arange(1.0, len(row) + 1), (row >= 40).astype(np.int32)
    table = np.random.default_rng(4).normal(size=(len(row), 3)).astype(np.float32)
    whole = V.pa.RecordBatch.from_arrays([V.pa.array(kind), V.pa.array(row), V.pa.array(n), V._packed(table)], ["kind", "row", "n", "v"])
    got = [b for b in V.averaged(iter([whole.slice(0, 7), whole.slice(7, 20), whole.slice(27)]), 3)]
    rows = [(k, r) for b in got for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert rows == [(int(r >= 40), r) for r in range(50)]
    want = [table[row == r].astype(float).sum(axis=0) / n[row == r].sum() for r in range(50)]
    assert np.allclose(np.concatenate([V._unpacked(b.column(2), 3) for b in got]), want, atol=1e-6)
    assert list(V.averaged(iter([]), 3)) == []
