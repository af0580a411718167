"""The k most similar vectors for each query vector, exactly or by an index of inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that meet a block's vectors in one product, and vectors and queries that a task holds.
QUERY_ROWS, BLOCK_ROWS, TILE_ROWS = 256, 20_000, 4096


def unit_rows(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of length one and of the given width, filled up with zeros; null vectors and those of zeros alone are zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors.to_pylist()):
        if v:
            row = np.array([0.0 if x is None else x for x in v], dtype=np.float64)
            out[k, : len(row)] = row
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _best(own: np.ndarray, ids: np.ndarray, similar: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query's row: the most similar to nine digits, ties by id, not the query itself."""
    value = np.where(ids == own, -np.inf, np.round(similar, 9))
    least = np.partition(value, -k)[-k] if len(value) > k else -np.inf
    near = np.flatnonzero((value >= least) & (value > -np.inf))
    return near[np.lexsort((ids[near], -value[near]))[:k]]


def _meeting(k: int):
    """What a tile of queries (query_id, q) finds in a block of vectors (vec_id, v): each query's k best."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held, similar = [], [], []
        if left.num_rows and right.num_rows:
            width = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (left["q"], right["v"]))
            ids, rows = right["vec_id"].to_numpy(), unit_rows(right["v"], width)
            own = left["query_id"].to_numpy()
            for at in range(0, len(own), QUERY_ROWS):
                part = unit_rows(left["q"].slice(at, QUERY_ROWS), width) @ rows.T
                for one, row in zip(own[at : at + QUERY_ROWS], part, strict=True):
                    best = _best(one, ids, row, k)
                    asked += [one] * len(best)
                    held.append(ids[best])
                    similar.append(row[best])
        join = lambda parts: np.concatenate(parts) if parts else []
        return pa.table({"query_id": pa.array(asked, left.schema.field("query_id").type), "vec_id": pa.array(join(held), right.schema.field("vec_id").type), "similarity": pa.array(join(similar), pa.float64())})

    return meet


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = [F.round("similarity", 9).desc(), F.col("vec_id")]
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("query_id", "vec_id", "similarity", "rank")


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): cosine, ties by id, a vector not with itself.

    Tiles of queries meet blocks of vectors, as products of matrices: each meeting's best k are chosen before blocks
    meet, so what moves is queries x blocks x k rows. A task holds a block and a tile, of about BLOCK_ROWS and TILE_ROWS
    rows, so that their number grows with the rows; the caller may ask for more blocks. The query set is stated by the
    caller. Vectors shorter than others are filled up with zeros.
    """
    least = blocks or max(8, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(least, -(-vectors.count() // BLOCK_ROWS))
    tiles = max(1, -(-queries.count() // TILE_ROWS))
    kind = vectors.schema[id_col].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q")).withColumn("tile", deal("query_id", tiles)).withColumn("block", every(blocks))
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).withColumn("block", deal("vec_id", blocks)).withColumn("tile", every(tiles))

    near = q.groupBy("block", "tile").cogroup(v.groupBy("block", "tile")).applyInArrow(_meeting(k), f"query_id {kind}, vec_id {kind}, similarity double")
    return _ranked(near, k)


#: Of an index: rows that its lists are made from at most, lists at most, rounds of means, queries that calibrate it.
SAMPLE_ROWS, LISTS, ROUNDS, TRIALS = 20_000, 1024, 12, 300


@dataclass(frozen=True)
class VectorIndex:
    """Inverted lists: each vector is in the list of the centroid it is most like, and a query looks through the lists of its `probes` most similar centroids, exactly. What lies in other lists is missed."""

    centroids: np.ndarray
    probes: int

    @staticmethod
    def fit(vectors: DataFrame, k: int = 3, recall: float = 0.99, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Centroids by spherical k-means over a sample of at most sample_rows vectors in hash order, about the root of the rows' number and at most LISTS; as many probes as find `recall` of the k best of TRIALS sampled vectors within the sample."""
        n = vectors.count()
        order = F.xxhash64(F.col(id_col), F.lit(seed))
        held = vectors.select(F.col(vector_col).alias("v")).filter(F.col("v").isNotNull()).orderBy(order, id_col).limit(sample_rows).toArrow()
        width = pc.max(pc.list_value_length(held["v"])).as_py() if held.num_rows else 0
        rows = unit_rows(held["v"], width or 0)
        rows = rows[np.abs(rows).sum(axis=1) > 0]
        if not len(rows):
            return VectorIndex(np.zeros((1, width or 0)), 1)
        lists = min(lists or max(1, int(np.sqrt(n))), LISTS, len(rows))
        centers = rows[np.random.default_rng(seed).choice(len(rows), lists, replace=False)]
        for _ in range(ROUNDS):
            near = nearest_lists(rows, centers, 1)[:, 0]
            sums = np.zeros_like(centers)
            np.add.at(sums, near, rows)
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centers = np.where(size > 0, sums / np.maximum(size, 1e-300), centers)
        own = nearest_lists(rows, centers, 1)[:, 0]
        trials = rows[:TRIALS]
        similar = trials @ rows.T
        similar[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
        best = np.argsort(-similar, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
        asked = nearest_lists(trials, centers, lists)
        # at which probe each of the best is met
        place = np.empty_like(asked)
        np.put_along_axis(place, asked, np.arange(lists)[None, :].repeat(len(trials), axis=0), axis=1)
        met = np.sort(np.take_along_axis(place, own[best], axis=1).reshape(-1))
        return VectorIndex(centers, int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) + 1 if len(met) else lists)

    def search(self, queries: DataFrame, vectors: DataFrame, k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, vec_id, similarity, rank) as top_similar has it, over all vectors, from the lists that each query probes.

        Lists of more than BLOCK_ROWS vectors are several blocks, and the queries of a list several tiles, so that no
        task grows with the rows. Null vectors and those of zeros alone are in the first list.
        """
        kind = vectors.schema[id_col].dataType.simpleString()
        centers, probes = self.centroids, min(self.probes, len(self.centroids))

        def placed(n: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    near = nearest_lists(unit_rows(batch.column(1), centers.shape[1]), centers, n)
                    at = np.repeat(np.arange(batch.num_rows), n)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(near.reshape(-1).astype(np.int32))], ["id", "v", "list"])

            return run

        shaped = lambda df, n: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(placed(n), f"id {kind}, v array<double>, list int")
        v, q = shaped(vectors, 1), shaped(queries, probes)
        # one row a list
        rooms = v.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(q.groupBy("list").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles")), "list")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        v = v.join(F.broadcast(rooms), "list").withColumn("block", deal("blocks")).withColumn("tile", every("tiles")).select("list", "block", "tile", F.col("id").alias("vec_id"), "v")
        q = q.join(F.broadcast(rooms), "list").withColumn("tile", deal("tiles")).withColumn("block", every("blocks")).select("list", "block", "tile", F.col("id").alias("query_id"), F.col("v").alias("q"))
        by = ["list", "block", "tile"]
        return _ranked(q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(_meeting(k), f"query_id {kind}, vec_id {kind}, similarity double"), k)


def nearest_lists(rows: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): the places of the centers that each row is most like, the most similar first, ties by place."""
    return np.argsort(-np.round(rows @ centers.T, 12), axis=1, kind="stable")[:, :n]
