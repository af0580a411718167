"""What the library does, by command: python -m sieveline COMMAND --help."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import language
from .functions.text import CLASS_ORDER, VIEWS, with_view
from .operators import build, enrich, ml, prompting, tagger
from .operators.sampling import class_cap, hash_order, stratified_split
from .operators.subset import Subset
from .sources.loaders import paths_below, report_lines
from .sources.shared import exists
from .sources.writers import read_master, write_splits, write_subset


def named_callable(name: str) -> Callable[[Sequence[str]], Sequence[str]]:
    """module:function, which takes prompts and gives answers."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A master table: CSV, or Parquet where the path says so."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_master(spark, path)


def run_build(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    options = build.Build(dedupe=not a.no_dedupe, exclude_ai=not a.keep_ai_generated, span_model=a.span_model, language_model=a.language_model, day_first=a.day_first)
    return build.summary(spark, build.run(spark, paths_below(a.raw_dir), a.output, options, a.resume))


def run_train_languages(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    labelled = spark.read.parquet(a.input)
    model = language.train_languages(labelled)
    model.save(spark, a.output)
    return labelled.select("lang", language.detect_language(F.col("text"), model)[0].alias("detected")).groupBy("lang", "detected").count()


def run_train_spans(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    examples = spark.read.parquet(a.input)
    model = tagger.train(examples, bits=a.bits, passes=a.passes)
    model.save(spark, a.output)
    return tagger.span_scores(examples.withColumn("found", tagger.span_column(model)(F.col("text"))))


def run_reports(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = report_lines(spark.read.text(a.input), a.source, a.address)
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(a.output)
    return rows.groupBy("original_label").count()


def run_enrich(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    records = spark.read.parquet(a.records) if a.records else spark.createDataFrame([], "domain string, age_days int, hidden boolean, country string")
    if not a.resume and exists(spark, a.output):
        raise ValueError(f"{a.output} is there: give --resume to go on from it")
    out = enrich.run_enrichment(spark, table(spark, a.input), a.output, named_callable(a.call), records, a.model, a.prompt_version, datetime.date.today().isoformat())
    return out.groupBy("theme").count()


def run_subset(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    wanted = Subset(a.labels or (), a.languages or (), a.sources or (), a.exclude_ai, a.only_ai, a.min_length, a.max_length, a.sample, a.seed, a.keep_cols or ())
    return write_subset(wanted.apply(table(spark, a.input)), a.output)


def run_splits(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = table(spark, a.input).filter(F.col("canonical_label").isin(*CLASS_ORDER))
    order = hash_order(a.seed, F.col("message_id"))
    capped = class_cap(rows, "canonical_label", "ham", "reference", a.max_ham_per_source, order)
    split = stratified_split(capped, "canonical_label", CLASS_ORDER, order)
    write_splits(split, a.output)
    return split.groupBy("split", "canonical_label").count()


def run_ml(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = with_view(table(spark, a.input), a.view).select(F.col("message_id").alias("id"), F.col("text_view").alias("text"), "canonical_label")
    df = ml.prepare(rows).persist()
    try:
        return ml.write_grid(df, a.output, json.loads(a.settings), a.dataset, encoders=a.encoders, classifiers=a.classifiers)
    finally:
        df.unpersist()


def run_scores(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    given = table(spark, a.input)
    results, cells = ml.scored_predictions(given, a.dataset, tuple(a.by))
    results = results.filter(F.col("n_samples") >= a.least)
    results.write.mode("overwrite").option("header", True).csv(f"{a.output.rstrip('/')}/results")
    cells.write.mode("overwrite").option("header", True).csv(f"{a.output.rstrip('/')}/confusion_matrices")
    return results


def run_llm(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = with_view(table(spark, a.input), a.view).select(F.xxhash64("message_id").alias("id"), F.col("text_view").alias("text"), "canonical_label")
    split = stratified_split(rows, "canonical_label", CLASS_ORDER, hash_order(a.seed, F.col("id"))).withColumnRenamed("canonical_label", "label")
    few = [tuple(x) for x in json.loads(a.examples)]
    # a stated number of test rows, in hash order
    test = split.filter("split = 'test'").orderBy(hash_order(a.seed + 1, F.col("id"))).limit(a.test_samples)
    return prompting.run_prompts(split.filter("split = 'train'").drop("split"), test.drop("split"), named_callable(a.call), a.model, a.output, few, a.dataset)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m sieveline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, about: str, source: str = "--input") -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about, description=about)
        p.add_argument(source, required=True)
        p.add_argument("--output", required=True)
        p.set_defaults(run=run)
        return p

    p = command("build", run_build, "the master table from a folder of raw files", "--raw-dir")
    for flag, about in (("--no-dedupe", "keep equal messages"), ("--resume", "go on from an earlier run"), ("--keep-ai-generated", "keep generated messages"), ("--day-first", "read slash dates day first")):
        p.add_argument(flag, action="store_true", help=about)
    p.add_argument("--span-model", help="a model of train-spans, whose spans are masked too")
    p.add_argument("--language-model", help="a model of train-languages")
    p = command("train-languages", run_train_languages, "a language model from Parquet of text, lang; prints how its texts are told")
    p = command("train-spans", run_train_spans, "a model of private spans from Parquet of text, spans (start, end, label); prints its scores on them")
    p.add_argument("--bits", type=int, default=tagger.BITS)
    p.add_argument("--passes", type=int, default=tagger.PASSES)
    p = command("reports", run_reports, "reports in lines of JSON as a table")
    p.add_argument("--source", default="reports")
    p.add_argument("--address", default="")
    p = command("enrich", run_enrich, "annotations and domain records for a master table, written as Parquet")
    p.add_argument("--call", required=True, help="module:function that answers prompts")
    p.add_argument("--records", help="Parquet of domain, age_days, hidden, country")
    p.add_argument("--model", default="model")
    p.add_argument("--prompt-version", default="v1")
    p.add_argument("--resume", action="store_true")
    p = command("subset", run_subset, "rows and columns of a master table")
    for flag in ("--labels", "--languages", "--sources", "--keep-cols"):
        p.add_argument(flag, nargs="+", choices=CLASS_ORDER if flag == "--labels" else None)
    for flag in ("--exclude-ai", "--only-ai"):
        p.add_argument(flag, action="store_true")
    for flag in ("--min-length", "--max-length", "--sample"):
        p.add_argument(flag, type=int, default=0)
    p.add_argument("--seed", type=int, default=42)
    p = command("splits", run_splits, "train, validation and test with ham capped by source")
    p.add_argument("--max-ham-per-source", type=int, default=20_000)
    p.add_argument("--seed", type=int, default=42)
    p = command("ml", run_ml, "encoders and classifiers over a master table")
    p.add_argument("--encoders", nargs="+", choices=list(ml.ENCODERS), default=list(ml.ENCODERS))
    p.add_argument("--classifiers", nargs="+", choices=list(ml.CLASSIFIERS), default=list(ml.CLASSIFIERS))
    p.add_argument("--view", choices=VIEWS, default="norm")
    p.add_argument("--dataset", default="all")
    p.add_argument("--settings", default="{}", help="JSON of vocabulary, dimensions, trees, depth, iterations")
    p = command("scores", run_scores, "scores of predictions made elsewhere (true_label, predicted_label)")
    p.add_argument("--by", nargs="+", default=["model_key"])
    p.add_argument("--least", type=int, default=1, help="rows that a group must have")
    p.add_argument("--dataset", default="all")
    p = command("llm", run_llm, "a model's answers in five ways of asking")
    p.add_argument("--call", required=True, help="module:function that answers prompts")
    p.add_argument("--model", default="model")
    p.add_argument("--examples", default="[]", help="JSON of [text, label] pairs")
    p.add_argument("--test-samples", type=int, default=1000)
    p.add_argument("--view", choices=VIEWS, default="norm")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--dataset", default="all")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("sieveline").getOrCreate(), a).show(100, truncate=False)
