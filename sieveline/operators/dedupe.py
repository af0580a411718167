"""Distinct by key, first wins, and the ledger of keys seen before."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists

#: Buckets of a new ledger: as many as a large shuffle has partitions, so that the rows that meet it are dealt as it lies.
BUCKETS = 256


def first_wins(df: DataFrame, key: str, *order: Column | str, keyless: bool = True) -> DataFrame:
    """One row of each key: the least by `order`, which should decide every tie. Rows with an empty or null key all stay, or (keyless=False) are one group of each, as GROUP BY has them.

    An aggregate rather than a window: a key's rows are reduced where they are read, so a key with very many rows
    costs one row a task in the shuffle. Rows without a key are groups of their own, spread over all tasks, so that df
    is worked out once.
    """
    names = df.columns
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    groups = [F.col(key).alias("_key")]
    if keyless:
        groups.append(F.when(F.coalesce(F.col(key), F.lit("")) == "", F.monotonically_increasing_id()).alias("_alone"))
    best = df.groupBy(*groups).agg(F.min_by(F.struct(*names), F.struct(*columns)).alias("_row"))
    return best.select("_row.*")


def unseen(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the ledger."""
    return df.join(ledger.select(key), key, "left_anti")


class Ledger:
    """Keys (text) seen before, by batch, in files that are bucketed by key: rows meet it as it lies, without an exchange of the ledger, and a batch that is written again replaces itself.

    The files are all there is; the table that Spark reads them by is made anew in each session. A ledger keeps the
    number of buckets that it began with, so that the caller must open it with the same.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "dedupe_key", buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.name = "sieveline_keys_" + hashlib.md5(self.path.encode(), usedforsecurity=False).hexdigest()[:16]
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        spark.sql(f"CREATE TABLE {self.name} ({key} STRING, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        if exists(spark, self.path):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")
        self.buckets = buckets

    def keys(self, batches: int) -> DataFrame:
        """The keys of the first so many batches."""
        return self.spark.table(self.name).filter(F.col("batch") < batches).select(self.key)

    def write(self, keys: DataFrame, batch: int) -> None:
        """Puts keys (its first column) in place of what the batch had; one file a bucket."""
        view = f"sieveline_{uuid.uuid4().hex}"
        keys.select(keys.columns[0]).repartition(self.buckets, keys.columns[0]).createOrReplaceTempView(view)
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch}) SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)
