"""The index of inverted lists against all pairs."""

import numpy as np
import pytest

from sieveline.operators import similarity as S

from .conftest import DATA


def found(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0")
    index = S.VectorIndex.fit(rows)
    exact, got = found(S.top_similar(asked, rows)), found(index.search(asked, rows))
    assert len(exact & got) >= 0.9 * len(exact)
    assert len(index.centroids) == int(np.sqrt(rows.count())) and 1 <= index.probes <= len(index.centroids)


def test_fewer_lists_are_searched_where_vectors_lie_in_groups(spark, monkeypatch):
    """Forty groups apart: a few probes find nearly all, in blocks and tiles of a few rows."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    rows = [(k, (centers[k % 40] + 0.2 * rng.normal(size=24)).tolist()) for k in range(3000)] + [(5000, None), (5001, [0.0] * 24), (5002, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = S.VectorIndex.fit(df)
    assert index.probes < 12
    exact = found(S.top_similar(df.filter("vec_id % 30 = 0"), df))
    monkeypatch.setattr(S, "BLOCK_ROWS", 25)
    monkeypatch.setattr(S, "TILE_ROWS", 3)
    got = index.search(df.filter("vec_id % 30 = 0"), df)
    assert len(exact & found(got)) >= 0.95 * len(exact) and got.groupBy("query_id").count().filter("count > 3").count() == 0


def test_all_lists_are_exact_and_empty_tables_have_none(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    index = S.VectorIndex.fit(rows, recall=1.0)
    every = S.VectorIndex(index.centroids, len(index.centroids))
    assert found(every.search(rows.limit(40), rows)) == found(S.top_similar(rows.limit(40), rows))
    none = rows.limit(0)
    assert S.VectorIndex.fit(none).search(none, none).count() == 0
    assert index.search(rows.limit(5), none).count() == 0
