"""Sparse weights by definition, and exact nearest rows against all pairs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.operators import prompting as P
from sieveline.operators import terms as M
from sieveline.operators.similarity import top_similar


def corpus(seed, n, words=60):
    rnd = random.Random(seed)
    common, rare = [f"c{k}" for k in range(6)], [f"word{k}" for k in range(words)]
    return [(k, " ".join([rnd.choice(common) for _ in range(rnd.randrange(8))] + [rnd.choice(rare) for _ in range(rnd.randrange(5))])) for k in range(n)] + [(n, ""), (n + 1, None), (n + 2, "c1 c1"), (n + 3, "c1 c1")]


def weights(rows, sublinear=True):
    counts = {i: Counter(re.findall(r"\b\w\w+\b", (t or "").lower())) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(n) if sublinear else n) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / size for t, x in w.items()}
    return out


def made(spark, rows, sublinear=True):
    df = spark.createDataFrame(rows, "id long, text string")
    counts = M.term_counts(df, pairs=False)
    return M.tfidf(counts, M.document_frequencies(counts), len(rows), sublinear)


def best(queries, rows, k):
    out = []
    for q, a in queries.items():
        near = sorted((-round(sum(x * b.get(t, 0.0) for t, x in a.items()), 9), i) for i, b in rows.items() if a.keys() & b.keys())[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("first_rows", [1, 20, 10**6])
def test_nearest_equals_all_pairs(spark, first_rows):
    rows = corpus(1, 250)
    own = weights(rows)
    w = made(spark, rows).checkpoint()
    for k in (1, 3, 400):
        got = sorted((r["query_id"], r["id"], r["similarity"], r["rank"]) for r in M.nearest(w.filter("id % 10 = 0"), w, k, first_rows).collect())
        want = best({i: v for i, v in own.items() if i % 10 == 0}, own, k)
        assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
        assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in want], abs=2e-9)


def test_weights_by_definition(spark):
    rows = corpus(2, 60)
    for sublinear in (True, False):
        got = {(r["id"], r["term"]): r["weight"] for r in made(spark, rows, sublinear).collect()}
        want = {(i, t): x for i, w in weights(rows, sublinear).items() for t, x in w.items()}
        assert got == pytest.approx(want)


def test_examples_of_a_vocabulary_that_would_collide(spark):
    """Thousands of words that occur once beside the one that counts."""
    train = [(k, f"noise{k}a noise{k}b noise{k}c topic{k % 900}", "ham" if k % 2 else "spam") for k in range(2700)]
    test = [(10_000 + k, f"unseen{k} topic{k}", "ham") for k in range(0, 900, 90)]
    kinds = "id long, text string, label string"
    got = {r["id"]: r["examples"] for r in P.nearest_examples(spark.createDataFrame(test, kinds), spark.createDataFrame(train, kinds)).collect()}
    assert len(got) == 10
    for i, shown in got.items():
        assert [e["text"].split()[-1] for e in shown] == [f"topic{i - 10_000}"] * 3
        assert [e["label"] for e in shown] == ["ham" if k % 2 else "spam" for k in range(i - 10_000, 2700, 900)]


def test_dense_blocks_grow_with_the_rows(spark, monkeypatch):
    """Small blocks and tiles give what one block gives."""
    from sieveline.operators import similarity as S

    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k * k)).alias("embedding"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in df.collect())
    whole = key(top_similar(rows.filter("vec_id % 7 = 0"), rows))
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    monkeypatch.setattr(S, "TILE_ROWS", 5)
    assert key(top_similar(rows.filter("vec_id % 7 = 0"), rows)) == whole and len(whole) == 43 * 3


def test_shared_totals_are_the_sums_of_kept_counts(spark):
    """No text is met by its terms again: only terms are exchanged, reduced where they are read, and one row an id."""
    texts = ["one two one two three", "two one", None, "", "alone alone", "three alone two one two", "only here only here"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "one here")], "id long, text string")
    counts = M.term_counts(rows)
    kept = M.kept_counts(counts, M.document_frequencies(counts, 2)).groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    want = {r["id"]: (r["n"], r["tf"]) for r in kept.filter("id is not null").collect()}
    found = M.shared_totals(rows)
    assert {r["id"]: (r["n"], r["tf"]) for r in found.collect()} == {k: want.get(k, (0, 0)) for k in (*range(len(texts)), None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate [id" not in plan  # by id, of what is to be taken off


def test_counts_of_single_texts_and_ends_of_weights(spark):
    """Equal to those of any rows, without an exchange for the counts, and with one row an id for the ends."""
    rows = spark.createDataFrame([(1, "One two one two three"), (2, "two ONE"), (3, None), (4, ""), (5, "three two one é_é")], "id long, text string")
    found = M.text_counts(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, M.term_counts(rows).collect()))
    df = M.text_frequencies(rows, 2)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, M.document_frequencies(M.term_counts(rows), 2).collect()))
    weights = M.tfidf(found, df, 5).groupBy("id").agg(F.count("*"), F.round(F.max("weight"), 9), F.round(F.min("weight"), 9))
    ends = M.weight_ends(found, df, 5).select("id", "n", F.round("largest", 9), F.round("least", 9))
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, weights.collect()))
    assert "Window" not in ends._jdf.queryExecution().optimizedPlan().toString()


def test_each_row_meets_each_query_and_tasks_send_their_best_alone(spark, monkeypatch):
    """Equal to all pairs, with several passes, several parts of a task, ties and terms in full and in lists."""
    monkeypatch.setattr(M, "QUERIES_AT_ONCE", 16)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 7)
    rows = corpus(4, 250)
    own = weights(rows)
    v = M.vectors_of(made(spark, rows)).repartition(3, "id").checkpoint()
    assert len(own[250]) == len(own[251]) == 0
    for dense in (0.2, 2.0):
        monkeypatch.setattr(M, "DENSE", dense)
        for k in (1, 3, 400):
            got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in M.nearest_vectors(v, v.filter("id % 10 = 0"), k).collect())
            want = sorted((a, r, b, s) for a, b, s, r in best({i: w for i, w in own.items() if i % 10 == 0}, own, k))
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)
