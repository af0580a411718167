"""Writers: the master table, names of outputs, options of a run, lines of JSON, splits, audits."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import MASTER_COLUMNS
from .shared import exists


def as_text(df: DataFrame, *more: str) -> DataFrame:
    """The master columns, and more of df's, as text, empty for null."""
    return df.select(*[F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit("")).alias(c) for c in (*MASTER_COLUMNS, *more)])


def write_master(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header each; append adds files, so that a header never stands among rows."""
    as_text(df).write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def read_master(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the paths that exists: the enriched table, else the plain one. A build's batches below it are one table."""
    from .loaders import read_csv

    return read_csv(spark, next(p for p in paths if exists(spark, p)), below=True)


def output_name(prefix: str = "master_v1", dedupe: bool = True, privacy: bool = False, with_ai: bool = False) -> str:
    return "".join([prefix, "_nodedupe" * (not dedupe), "_privacy" * privacy, "_with_ai" * with_ai, ".csv"])


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Adds CSV files with a header each: results and confusions as they come."""
    df.coalesce(1).write.mode("append").options(header=True).csv(path)


def write_subset(df: DataFrame, path: str) -> DataFrame:
    """Writes a subset as CSV and returns its summary, (canonical_label, n) with a row for all (null), most rows first; without labels the row for all alone."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)
    counted = df.rollup("canonical_label").agg(F.count("*").alias("n"), F.grouping("canonical_label").alias("all")) if "canonical_label" in df.columns else df.agg(F.lit(None).cast("string").alias("canonical_label"), F.count("*").alias("n"), F.lit(1).alias("all"))
    named = F.when(F.col("all") == 0, F.coalesce("canonical_label", F.lit("")))
    return counted.select(named.alias("canonical_label"), "n").orderBy(F.desc("n"), F.col("canonical_label").asc_nulls_first())


def write_audit(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quoteAll=True).csv(path)


def check_options(spark: SparkSession, path: str, options: Mapping[str, object]) -> None:
    """Stores a run's options beside its checkpoint the first time; later runs must have the same."""
    said = json.dumps(dict(options), sort_keys=True)
    if exists(spark, path):
        before = "\n".join(r.value for r in spark.read.text(path).collect())
        if json.loads(before) != json.loads(said):
            raise ValueError(f"this run's options {said} differ from those of the run it resumes: {before}")
        return
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("error").text(path)
