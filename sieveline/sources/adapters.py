"""What lives outside: models that answer prompts, services that are read page by page. Callables are given by the user and run on executors, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists

#: Ids of one page, attempts for a page, and empty ids in a row after which a service is taken to end.
PAGE_IDS, ATTEMPTS, EMPTY_RUN = 500, 3, 100


def answer(df: DataFrame, call: Callable[[Sequence[str]], Sequence[str]], id_col: str, prompt_col: str, batch: int = 128) -> DataFrame:
    """(id, response) of a model for every prompt. A batch whose call fails answers with its error, so that it can be found and tried again; blank prompts are not sent. Ids come back as they are, nulls and large numbers among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                prompts = part.column(1).to_pylist()
                sent = [p for p in prompts if p is not None and p.strip()]
                try:
                    got = iter(list(call(sent)) if sent else [])
                    said = [next(got) if p is not None and p.strip() else "" for p in prompts]
                except Exception as error:  # noqa: BLE001  the caller's model may raise anything
                    said = [f"ERROR: {error}"] * len(prompts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], [id_col, "response"])

    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("response", T.StringType())])
    return df.select(id_col, prompt_col).mapInArrow(run, kind)


def keyword_model(prompts: Sequence[str]) -> list[str]:
    """Stands in for a model where there is none: a label by a few words of the last message, as JSON."""
    out = []
    for p in prompts:
        low = p.rpartition("Message: ")[2].lower()
        label = "smishing" if any(w in low for w in ("http", "verify", "account", "password")) else "spam" if any(w in low for w in ("win", "free", "offer", "sale")) else "ham"
        out.append(f'{{"label": "{label}"}}')
    return out


def page_plan(spark: SparkSession, first: int, last: int, page: int = PAGE_IDS) -> DataFrame:
    """(first_id, last_id): the pages from first to last."""
    return spark.range(first, last + 1, page).select(F.col("id").alias("first_id"), F.least(F.col("id") + page - 1, F.lit(last)).alias("last_id"))


def fetch_pages(plan: DataFrame, fetch: Callable[[int], str | None], attempts: int = ATTEMPTS) -> DataFrame:
    """(message_id, payload, error): one row an id; payload is null where there is nothing, error where all attempts failed."""

    def one(i: int) -> tuple[int, str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return i, fetch(i), None
            except Exception as e:  # noqa: BLE001  the caller's service may raise anything
                error = str(e) or type(e).__name__
        return i, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in batches:
            for a, b in zip(pages.column(0).to_pylist(), pages.column(1).to_pylist(), strict=True):
                rows = [one(i) for i in range(a, b + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["message_id", "payload", "error"])

    return plan.select("first_id", "last_id").mapInArrow(run, "message_id long, payload string, error string")


def read_service(spark: SparkSession, fetch: Callable[[int], str | None], folder: str, first: int = 1, pages: int = 16, page: int = PAGE_IDS, attempts: int = ATTEMPTS, empty: int = EMPTY_RUN) -> int:
    """Reads a service id by id into folder until `empty` ids in a row hold nothing, and returns the last id that holds anything (0 for none).

    A round asks for `pages` pages, each by one task, and appends what it found as lines of JSON; ids whose attempts
    all failed go to a list of their own and count as empty. A later call goes on behind the last line, so that a run
    that broke off repeats one round at most. Empty ids are counted over the edges of rounds.
    """
    lines, failed = f"{folder.rstrip('/')}/records", f"{folder.rstrip('/')}/failed_ids"
    held = last_id(spark.read.text(lines)) if exists(spark, lines) else 0
    at = max(first, held + 1)
    while True:
        rows = fetch_pages(page_plan(spark, at, at + pages * page - 1, page), fetch, attempts).persist()
        try:
            before = spark.createDataFrame([(held, "")] if held else [], "message_id long, payload string")
            end = end_of_service(before.unionByName(rows.select("message_id", "payload")), empty, page) if held else end_of_service(rows, empty, page)
            found = rows.filter("payload is not null")
            if end is not None:
                found = found.filter(F.col("message_id") <= end)
            last = found.agg(F.max("message_id")).first()[0]
            if last is not None:
                found.select(F.col("payload").alias("value")).write.mode("append").text(lines)
            lost = rows.filter(F.col("error").isNotNull()).select("message_id", "error")
            if not lost.isEmpty():
                lost.coalesce(1).write.mode("append").options(header=True, quoteAll=True).csv(failed)
        finally:
            rows.unpersist()
        held = last or held
        if end is not None:
            return held
        at += pages * page


def last_id(lines: DataFrame) -> int:
    """The largest message_id in lines of JSON (column value), from which a reading goes on; 0 for none."""
    return lines.select(F.max(F.get_json_object("value", "$.message_id").try_cast("bigint"))).first()[0] or 0


def end_of_service(rows: DataFrame, run: int = EMPTY_RUN, page: int = PAGE_IDS) -> int | None:
    """The last id before the first `run` empty ids in a row; null if there is no such run.

    Ids with a payload are compared with the next one, first within their page, then over pages' first and last.
    """
    found = rows.filter("payload is not null").select("message_id", F.floor(F.col("message_id") / page).alias("p"))
    ends = rows.agg(F.min("message_id").alias("a"), F.max("message_id").alias("b")).first()
    inside = found.withColumn("next", F.lead("message_id").over(Window.partitionBy("p").orderBy("message_id"))).filter(F.col("next") - F.col("message_id") > run).agg(F.min("message_id")).first()[0]
    pages = found.groupBy("p").agg(F.min("message_id").alias("first"), F.max("message_id").alias("last"))
    if ends["a"] is None:
        return None
    between = pages.withColumn("next", F.lead("first", 1, ends["b"] + 1).over(Window.orderBy("p"))).filter(F.col("next") - F.col("last") > run).agg(F.min("last")).first()[0]
    start = pages.agg(F.min("first")).first()[0]
    lead = ends["a"] - 1 if (start or ends["b"] + 1) - ends["a"] >= run else None
    return min((x for x in (inside, between, lead) if x is not None), default=None)
