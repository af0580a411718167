"""The build: raw records of all sources to the master table.

Messages are cleaned and repaired, keyed, and made distinct across sources before anything dear is done with them:
masks, a model's spans and languages are worked out for the messages that stay.

A folder holds a build as batches, one a run: rows of the master table, keys of the ledger, and records read and rows
written by source. The last is written when the others are whole, so that a batch without it never was: a run that
resumes works it out anew and writes over it, and no row is there twice wherever a run was stopped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import message_key, with_masks, with_repairs
from ..functions.dates import normalize_timestamp
from ..functions.language import LanguageModel, detect_language
from ..functions.text import anonymization_status, clean_str, format_confidence, is_valid_message, mapping_rule, message_id, normalized_name, once
from ..sources.catalog import MASTER_COLUMNS, RECORD_ORDER
from ..sources.loaders import read_sources
from ..sources.shared import exists
from ..sources.writers import as_text, check_options, output_name, write_master
from .dedupe import BUCKETS, Ledger, first_wins, unseen
from .tagger import SpanTagger, span_column


@dataclass(frozen=True)
class Build:
    """Options of a build; those that change its rows are what a later run must share with the one it goes on from."""

    dedupe: bool = True
    exclude_ai: bool = True
    #: The path of a span model (`tagger.SpanTagger.save`), whose spans are masked beside the patterns'.
    span_model: str | None = None
    #: The path of a language model (`functions.language.LanguageModel.save`); unset, the one that is there without training.
    language_model: str | None = None
    #: Whether slash dates are read day first.
    day_first: bool = False
    #: Buckets of the ledger of keys.
    buckets: int = BUCKETS
    #: Whether runs of letters set apart are those that SQL tells (`functions.arrow.join_runs`).
    sql_runs: bool = False

    def said(self) -> dict[str, object]:
        """The options as they stand beside a build; sql_runs only where it is set, as builds from before it lack it."""
        return {k: v for k, v in asdict(self).items() if k != "sql_runs" or v}


def messages(raw: DataFrame, options: Build = Build()) -> DataFrame:
    """raw records that are messages, with text_raw, text (repaired), obfuscation_tags and dedupe_key."""
    if options.exclude_ai:
        raw = raw.filter(F.coalesce(F.col("is_ai_generated"), F.lit(0)) == 0)
    rows = once(raw, {"text_raw": clean_str(F.col("text"))}).drop("text")
    rows = with_repairs(rows.filter(is_valid_message(F.col("text_raw"))), "text_raw", "text", "obfuscation_tags", options.sql_runs)
    return rows.withColumn("dedupe_key", message_key(F.col("text"), settled=True))


def distinct(rows: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first row of each key in the order of the records, without those whose key is in the ledger (column dedupe_key)."""
    fresh = unseen(rows, ledger, "dedupe_key") if ledger is not None else rows
    return first_wins(fresh, "dedupe_key", *RECORD_ORDER)


def master(rows: DataFrame, options: Build = Build(), model: object = None) -> DataFrame:
    """The 26 columns, as text, and dedupe_key, of rows as `messages` gives them. model: finds spans(text) in what `functions.arrow.prepare` gives of the repaired text; unset, the one that the options name, if they do."""
    if model is None and options.span_model:
        model = SpanTagger.load(rows.sparkSession, options.span_model)
    if model is not None:
        rows = once(rows, {"model_spans": span_column(model)(F.col("text"))})
    rows = with_masks(rows, "text", "text_anonymized", "n_entities", "model_spans" if model is not None else None)
    known = LanguageModel.load(rows.sparkSession, options.language_model) if options.language_model else None
    language, confidence = detect_language(F.col("text_anonymized"), known)
    rows = once(rows, {"language": language, "language_confidence": confidence})
    original = F.coalesce(F.nullif(F.col("original_label"), F.lit("")), F.lit("unlabeled"))
    reference = normalized_name(F.col("source"))
    found = {
        "message_id": message_id(reference, F.col("source_id"), F.col("text")),
        "reference": reference,
        "source_id": F.trim("source_id"),
        "original_label": F.trim(original),
        "label_mapping_rule": mapping_rule(F.col("label_mapping_rule"), original, F.col("canonical_label")),
        "timestamp_original": normalize_timestamp(F.col("timestamp_original"), options.day_first),
        "license": normalized_name(F.col("license")),
        "is_ai_generated": F.when(F.coalesce(F.col("is_ai_generated"), F.lit(0)) != 0, "1").otherwise("0"),
        "language_confidence": format_confidence(F.col("language_confidence")),
        "obfuscation_tags": F.array_join("obfuscation_tags", ","),
        "anonymization_status": anonymization_status(F.col("text_raw"), F.col("text"), F.col("text_anonymized")),
    }
    named = rows.select(*[found.get(c, F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in MASTER_COLUMNS], "dedupe_key")
    return as_text(named, "dedupe_key")


def build(raw: DataFrame, options: Build = Build(), ledger: DataFrame | None = None, model: object = None) -> DataFrame:
    """raw records (`catalog.RAW`) to master rows with their dedupe_key.

    Records without a text, or with one that is no message, go; so do generated ones unless the options keep them.
    Of messages with equal keys the first in the order of the records stays, whatever its source. Empty tables give no
    rows; null labels stay as empty text.
    """
    rows = messages(raw, options)
    if options.dedupe:
        rows = distinct(rows, ledger)
    return master(rows, options, model)


#: Records read and rows written of a source in a batch.
PROGRESS = "reference string, seen long, written long"


def _batch(path: str, n: int) -> str:
    return f"{path}/batch-{n:05d}"


def batches(spark: SparkSession, path: str) -> int:
    """How many whole batches the build at a master's path has."""
    n = 0
    while exists(spark, f"{_batch(_beside(path, 'progress'), n)}/_SUCCESS"):
        n += 1
    return n


def _beside(path: str, what: str) -> str:
    return f"{path.removesuffix('.csv')}.{what}"


def _emptied(spark: SparkSession, path: str) -> None:
    """Leaves a folder without a file: a partitioned table without rows has none."""
    spark.createDataFrame([], "part string, none string").write.partitionBy("part").mode("overwrite").csv(path)


def run_records(raw: DataFrame, folder: str, options: Build = Build(), resume: bool = False, model: object = None) -> str:
    """Builds from raw records into folder: the master CSV, the ledger of keys, the progress, the options. Returns the master's path.

    A run that resumes must have the options of the run before; it adds what the ledger does not hold. Without
    deduplication a second run would repeat rows, so it is refused. A run that does not resume begins anew. Until a
    run that was stopped is resumed, the master's folder may hold rows of its unfinished batch.
    """
    spark = raw.sparkSession
    private = options.span_model is not None or model is not None
    path = f"{folder.rstrip('/')}/{output_name(dedupe=options.dedupe, privacy=private, with_ai=not options.exclude_ai)}"
    keys, progress, said = (_beside(path, x) for x in ("keys", "progress", "options"))
    n = batches(spark, path) if resume else 0
    if n and not options.dedupe:
        raise ValueError("a run without deduplication can't go on from another")
    if resume:
        check_options(spark, said, options.said())
    else:
        for old in (progress, keys, path):  # the progress first: without it nothing else counts
            if exists(spark, old):
                _emptied(spark, old)
    ledger = Ledger(spark, keys, buckets=options.buckets)
    staged = _beside(path, "staged")
    build(raw, options, ledger.keys(n) if n else None, model).write.mode("overwrite").parquet(staged)  # worked out once, for the table and for the ledger
    done = spark.read.parquet(staged)
    write_master(done, _batch(path, n))
    ledger.write(done.filter("dedupe_key != ''").select("dedupe_key"), n)
    seen = raw.groupBy(normalized_name(F.col("source")).alias("reference")).agg(F.count("*").alias("seen"))
    written = done.groupBy(F.col("reference").alias("r")).agg(F.count("*").alias("written"))
    counted = seen.join(written, F.col("reference") == F.col("r"), "left").select("reference", "seen", F.coalesce("written", F.lit(0)).cast("long").alias("written"))
    counted.coalesce(1).write.mode("overwrite").parquet(_batch(progress, n))  # last: a batch with it is whole
    return path


def run(spark: SparkSession, paths: Mapping[str, str | Sequence[str]], folder: str, options: Build = Build(), resume: bool = False) -> str:
    """`run_records` from the sources at paths."""
    return run_records(read_sources(spark, paths), folder, options, resume)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(reference, seen, written): the records that the last run read and the rows that all runs wrote, of each source and of all (reference null)."""
    progress, n = _beside(path, "progress"), batches(spark, path)
    if not n:
        return spark.createDataFrame([(None, 0, 0)], PROGRESS)
    each = None
    for k in range(n):
        part = spark.read.schema(PROGRESS).parquet(_batch(progress, k))
        part = part if k == n - 1 else part.withColumn("seen", F.lit(0).cast("long"))
        each = part if each is None else each.unionByName(part)
    return each.rollup("reference").agg(F.sum("seen").alias("seen"), F.sum("written").alias("written"))
