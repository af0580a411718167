"""Models that answer prompts, scored over the ways of asking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.responses import PROMPTS, label_of_response, prompt
from ..functions.text import CLASS_ORDER
from ..sources.adapters import answer
from ..sources.shared import exists, new_path, shared_dir
from ..sources.writers import append_rows
from .metrics import confusion, scores
from .terms import document_frequencies, nearest, term_counts, tfidf

#: Examples that a prompt shows.
EXAMPLES = 3

SCORES = "dataset string, model_key string, n_samples long, accuracy double, macro_f1 double, " + ", ".join(f"f1_{c} double" for c in CLASS_ORDER)


def nearest_examples(test: DataFrame, train: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """(id, examples): the k training messages most like each test message by the cosine of their TF-IDF over all words of the training messages, as structs (text, label), the nearest first. Both: (id long, text, label). Test messages that share no word with any training message have no row."""
    shared_dir(train.sparkSession)
    counts = term_counts(train.select("id", "text"), pairs=False).checkpoint()
    known, n = document_frequencies(counts), train.count()
    rows = tfidf(counts, known, n, sublinear=False).checkpoint()
    found = nearest(tfidf(term_counts(test.select("id", "text"), pairs=False), known, n, sublinear=False), rows, k)
    shown = found.join(train.select("id", "text", "label"), "id")
    near = shown.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "text", "label"))).alias("e"))
    return near.select("id", F.transform("e", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))).alias("examples"))


def asked(test: DataFrame, name: str, examples: Sequence[tuple[str, str]], near: DataFrame | None = None) -> DataFrame:
    """(id, true_label, text, prompt) in one of PROMPTS. examples: (text, label) of the fixed few; near: what nearest_examples found."""
    shown = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("label")) for t, x in examples])
    rows = test
    if near is not None and name.startswith("dynamic"):
        rows = test.join(near, "id", "left").withColumn("examples", F.coalesce("examples", shown))
    else:
        rows = test.withColumn("examples", shown)
    return rows.select("id", F.col("label").alias("true_label"), "text", prompt(name, F.col("text"), shown, F.col("examples")).alias("prompt"))


def run_prompts(train: DataFrame, test: DataFrame, call: Callable[[Sequence[str]], Sequence[str]], model: str, folder: str, examples: Sequence[tuple[str, str]], dataset: str = "all", names: Iterable[str] = tuple(p[0] for p in PROMPTS)) -> DataFrame:
    """Asks a model in every way that folder's results lack, and returns all results. Scores, confusions and raw answers are appended way by way, so that a run can stop and go on. train, test: (id long, text, label)."""
    spark = test.sparkSession
    results, confusions, raw = (f"{folder.rstrip('/')}/{n}" for n in ("results", "confusion_matrices", "raw_predictions"))
    read = lambda: spark.read.schema(SCORES).option("header", True).csv(results)
    done = {r["model_key"] for r in read().filter(F.col("dataset") == dataset).collect()} if exists(spark, results) else set()
    near = None
    for name in names:
        key = f"{model}_{name}"
        if key in done:
            continue
        if name.startswith("dynamic") and near is None:
            near = nearest_examples(test, train)
        prompts = asked(test, name, examples, near)
        path = new_path(spark, "answers")  # a model is asked once, whatever is counted from its answers
        answer(prompts.select(F.struct("id", "true_label", "text").alias("row"), "prompt"), call, "row", "prompt").write.parquet(path)
        told = spark.read.parquet(path).select(F.lit(dataset).alias("dataset"), F.lit(key).alias("model_key"), "row.true_label", label_of_response(F.col("response")).alias("predicted_label"), "row.text", "response")
        by = ("dataset", "model_key")
        told.write.mode("append").options(header=True, quote='"', escape='"').csv(raw)
        append_rows(confusion(told, by=by), confusions)
        append_rows(scores(told, by=by), results)  # last: a result stands for a whole way of asking
    return read().orderBy("dataset", F.desc("macro_f1"), "model_key")
