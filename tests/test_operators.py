"""Relational operators, published numbers, properties."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions.text import CLASS_ORDER
from sieveline.operators import metrics as M
from sieveline.operators.dedupe import first_wins, unseen
from sieveline.operators.enrich import latest
from sieveline.operators.sampling import hash_order, largest_remainder, ranked, split_quotas, stratified_sample, stratified_split
from sieveline.operators.similarity import top_similar
from sieveline.operators.subset import Subset


def test_published_split_sizes():
    quotas = split_quotas({"ham": 376109, "spam": 28141, "smishing": 50614})
    assert [q[0] for q in quotas.values()] == [300887, 22513, 40491]
    assert [q[1] for q in quotas.values()] == [37611, 2814, 5061]
    assert [q[2] for q in quotas.values()] == [37611, 2814, 5062]


def test_largest_remainder_adds_up():
    for total in range(0, 30):
        assert sum(largest_remainder({"a": 5, "b": 3, "c": 3}, total).values()) == total
    assert largest_remainder({"a": 0}, 0) == {"a": 0}


def test_published_scores(spark):
    cells = [[36943, 328, 340], [171, 1902, 741], [126, 1204, 3732]]
    pairs = [(t, p, n) for t, row in zip(CLASS_ORDER, cells) for p, n in zip(CLASS_ORDER, row)]
    rows = spark.createDataFrame(pairs, "true_label string, predicted_label string, n int").select("true_label", "predicted_label", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    got = M.scores(rows).first()
    assert got["accuracy"] == pytest.approx(0.9360256776661464, abs=1e-12)
    assert got["macro_f1"] == pytest.approx(0.7839302163607478, abs=1e-12)
    assert [got[f"f1_{c}"] for c in CLASS_ORDER] == pytest.approx([0.9871077206717345, 0.6088348271446863, 0.7558481012658228], abs=1e-12)
    assert {(r[0], r[1]): r[2] for r in M.confusion(rows).collect()} == {(t, p): n for t, p, n in pairs}


def test_one_class_slice_scores_a_third(spark):
    rows = spark.createDataFrame([("ham", "ham")] * 10, "true_label string, predicted_label string")
    got = M.scores(rows).first()
    assert got["accuracy"] == 1.0 and got["macro_f1"] == pytest.approx(1 / 3)


def test_first_wins(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "", 0), (4, None, 0), (5, "", 0), (6, "b", 0)], "i int, k string, o int")
    once = first_wins(rows, "k", "o", "i")
    assert sorted(r["i"] for r in once.collect()) == [2, 3, 4, 5, 6]
    assert sorted(r["i"] for r in first_wins(once, "k", "o", "i").collect()) == [2, 3, 4, 5, 6]
    assert [r["i"] for r in unseen(rows, rows.filter("k = 'a'"), "k").orderBy("i").collect()] == [3, 4, 5, 6]


def test_ranks_equal_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(500).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    h = hash_order(1, F.col("id"))
    got = {r["id"]: r["rank"] for r in ranked(rows, ["g"], h).collect()}
    want = {r["id"]: r["r"] for r in rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(h))).collect()}
    assert got == want


def test_splits_are_exact_and_disjoint(spark):
    rows = spark.range(333).select("id", F.when(F.col("id") % 10 < 7, "ham").when(F.col("id") % 10 < 9, "spam").otherwise("smishing").alias("l"))
    got = stratified_split(rows, "l", CLASS_ORDER, hash_order(42, F.col("id"))).collect()
    assert len(got) == 333 == len({r["id"] for r in got})
    assert sum(r["split"] == "test" for r in got) == 34 and sum(r["split"] == "val" for r in got) == 33


def test_sample_is_exact(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.lit("ham")).alias("l"))
    for n in (1, 50, 199, 200, 500):
        assert stratified_sample(rows, "l", n, hash_order(42, F.col("id")), CLASS_ORDER).count() == min(n, 200)


def test_subset_without_ai_column(spark):
    rows = spark.createDataFrame([("1", "ham", "abc"), ("2", "spam", None)], "message_id string, canonical_label string, text string")
    assert Subset(only_ai=True).apply(rows).count() == 0
    assert Subset(exclude_ai=True, only_ai=True).apply(rows).count() == 2
    assert Subset(min_length=1).apply(rows).count() == 1
    flagged = rows.withColumn("is_ai_generated", F.when(F.col("message_id") == "1", "1").otherwise("bad"))
    assert [r["message_id"] for r in Subset(exclude_ai=True).apply(flagged).collect()] == ["2"]


def test_latest_replaces(spark):
    rows = spark.createDataFrame([("a", 1, "ERROR"), ("a", 2, "ok"), ("b", 1, "ok")], "id string, t int, s string")
    assert sorted((r["id"], r["s"]) for r in latest(rows, "id", "t").collect()) == [("a", "ok"), ("b", "ok")]


def test_top_similar(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [0.0, 0.0])], "vec_id int, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in top_similar(rows.filter("vec_id = 5"), rows, k=2).orderBy("rank").collect()]
    assert got == [(5, 4), (5, 3)]


def test_top_similar_equals_all_pairs(spark):
    """Ties, zero vectors, nulls and short vectors among them."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)] + [(200, [1.0]), (201, None), (202, [0.0] * 4), (203, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: (lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x)(np.array(((v or []) + [0.0] * 4)[:4])) for i, v in rows}
    want = {q: [v for _, v in sorted((-round(float(unit[q] @ unit[v]), 9), v) for v in unit if v != q)[:3]] for q in unit if q % 20 == 0 or q > 199}
    got = {}
    for r in top_similar(df.filter("vec_id % 20 = 0 or vec_id > 199"), df, k=3, blocks=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    assert top_similar(df.limit(0), df).count() == 0 and top_similar(df, df.limit(0)).count() == 0
