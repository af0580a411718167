"""The build as a resumable stream: new files in, messages that were not seen before out.

State is every key so far, as in the batch build. For a feed without end, `within` bounds it: keys older than that
are forgotten, which lets late repeats through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import message_key, with_repairs
from ..functions.text import clean_str, is_valid_message, once
from ..sources.writers import check_options


def distinct_messages(stream: DataFrame, text_col: str = "text", time_col: str | None = None, within: str | None = None, sql_runs: bool = False) -> DataFrame:
    """Cleaned (text_clean) and repaired (text_repaired, tags), valid messages by the key that the build of the same sql_runs has for them, the first that arrives."""
    rows = once(stream, {"text_clean": clean_str(F.col(text_col))})
    rows = with_repairs(rows.filter(is_valid_message(F.col("text_clean"))), "text_clean", "text_repaired", "tags", sql_runs)
    rows = rows.withColumn("dedupe_key", message_key(F.col("text_repaired")))
    if time_col and within:
        return rows.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["dedupe_key"])
    return rows.dropDuplicates(["dedupe_key"])


def run_available(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, options: Mapping[str, object] | None = None) -> None:
    """Takes all files that are new since the last run, and ends. A second run with other options is refused."""
    check_options(spark, f"{checkpoint}/options.json", dict(options or {}))
    stream = distinct_messages(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/stream").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows. An addition of ours: the batch build has no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
