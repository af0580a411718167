"""Encoders and classifiers on MLlib, and the grid that evaluates their combinations.

Where MLlib has no equal of what the published numbers used, the nearest is taken: one-vs-rest for the linear SVM. Word
vectors are our own (`embeddings`), averaged over tasks in each pass; forests are MLlib's down to some level and our own
below it (`forest`). Results are comparable in shape, not in the last digit.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, Transformer  # noqa: F401
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CLASS_ORDER, label_id
from ..sources.shared import exists, shared_dir
from ..sources.writers import append_rows
from .embeddings import BUCKETS, WordVectors
from .forest import DeepForest, DeepForestModel
from .metrics import balanced_weights, confusion, scores
from .sampling import hash_order, stratified_split

VOCABULARY, DIMENSIONS = 50_000, 100
#: Classifiers that pass over the rows very many times; how many rows a task has then at least, and how many tasks there are at most, as each iteration moves a vector of the vocabulary's width from each.
ITERATIVE, ROWS_A_TASK, TASKS = frozenset(("logreg", "svm")), 5_000, 12
#: A fit ends when a step gains less than this share, or after its iterations.
TOLERANCE = 1e-4


def _words(gaps: bool = False) -> RegexTokenizer:
    """Words of two and more characters, or (gaps) whatever white space leaves."""
    pattern = r"\s+" if gaps else r"(?U)\b\w\w+\b"
    return RegexTokenizer(inputCol="text", outputCol="words", pattern=pattern, gaps=gaps)


def _grams() -> list[Transformer]:
    return [_words(), NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__")]


class _Counts(CountVectorizer):
    """Counts of the most frequent terms that two texts have, ties by the term. The vocabulary comes of one aggregate, in which terms are reduced where they are read and the two texts are told by their numbers."""

    def fit(self, dataset: DataFrame, params: object = None) -> CountVectorizerModel:
        texts = dataset.select(F.monotonically_increasing_id().alias("text"), F.col(self.getInputCol()).alias("terms"))  # before the terms are set apart
        each = texts.select("text", F.explode("terms").alias("term"))
        found = each.groupBy("term").agg(F.count("*").alias("n"), F.min("text").alias("least"), F.max("text").alias("most")).filter("least != most")
        words = [r["term"] for r in found.orderBy(F.desc("n"), "term").limit(self.getVocabSize()).select("term").collect()]
        if not words:
            raise ValueError("no term is in two texts")
        return CountVectorizerModel.from_vocabulary(words, self.getInputCol(), self.getOutputCol())


def _counts(out: str, vocabulary: int) -> _Counts:
    return _Counts(inputCol="grams", outputCol=out, vocabSize=vocabulary)


def bow(vocabulary: int = VOCABULARY) -> list:
    return [*_grams(), _counts("features", vocabulary)]


def tfidf(vocabulary: int = VOCABULARY) -> list:
    """Logarithmic counts, smooth inverse document frequencies plus one, unit length; all of them sparse."""
    return [*_grams(), _counts("counts", vocabulary), _Sublinear(inputCol="counts", outputCol="logs"), _SmoothIdf(inputCol="logs", outputCol="weighted"), Normalizer(p=2.0, inputCol="weighted", outputCol="features")]


def sublinear(vectors: pa.StructArray) -> pa.StructArray:
    """1 + ln of each positive count; dense vectors stay dense and sparse ones sparse."""
    kind, size, indices, values = vectors.flatten()
    counts = values.values.to_numpy()
    logs = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1e-300)), 0.0)
    held = pa.ListArray.from_arrays(values.offsets, pa.array(logs), type=values.type, mask=values.is_null())
    return pa.StructArray.from_arrays([kind, size, indices, held], fields=list(vectors.type), mask=vectors.is_null())


class _Sublinear(SQLTransformer):
    """`sublinear` of a column of vectors, batch by batch. Columns that were only steps towards the counts stay behind."""

    def __init__(self, inputCol: str, outputCol: str):  # noqa: N803
        super().__init__(statement="SELECT * FROM __THIS__")
        self._input, self._output = inputCol, outputCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = [c for c in dataset.columns if c not in ("text", "words", "pairs", "grams", self._input)]
        rows = dataset.select(*kept, F.col(self._input).alias(self._output))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *others, counts = batch.columns
                yield pa.RecordBatch.from_arrays([*others, sublinear(counts)], schema=batch.schema)

        return rows.mapInArrow(run, rows.schema)


class _SmoothIdf(IDF):
    """ln((n + 1) / (df + 1)) + 1 for each term, as a product with one vector, which keeps sparse vectors sparse."""

    def fit(self, dataset: DataFrame, params: object = None) -> ElementwiseProduct:
        found = IDF(inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(dataset)
        return ElementwiseProduct(scalingVec=Vectors.dense(found.idf.toArray() + 1.0), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def w2v(dimensions: int = DIMENSIONS, iterations: int = 5) -> list:
    """Means of word vectors; words that have none don't count."""
    return [_words(gaps=True), WordVectors(options={"dimensions": dimensions, "passes": iterations})]


def subword(dimensions: int = DIMENSIONS, iterations: int = 5) -> list:
    """Means of vectors that words share by their character n-grams, so that every word has one."""
    return [_words(gaps=True), WordVectors(options={"dimensions": dimensions, "passes": iterations, "buckets": BUCKETS})]


ENCODERS: Mapping[str, Callable[..., list]] = {"bow": bow, "tfidf": tfidf, "w2v": w2v, "fasttext": subword}
SPARSE = frozenset(("bow", "tfidf"))


def nb(sparse: bool = True, **_: object) -> Estimator:
    return NaiveBayes(modelType="multinomial" if sparse else "gaussian", labelCol="label", featuresCol="features")


def logreg(n_rows: int = 1, iterations: int = 2000, **_: object) -> Estimator:
    return LogisticRegression(family="multinomial", maxIter=iterations, tol=TOLERANCE, standardization=False, regParam=1.0 / max(1, n_rows), weightCol="weight", labelCol="label")


def rf(trees: int = 200, depth: int = 8, **_: object) -> DeepForest:
    """depth: levels that MLlib grows; below them trees go on without a limit."""
    return DeepForest(trees=trees, levels=depth)


def svm(iterations: int = 2000, n_rows: int = 1, **_: object) -> Estimator:
    """The three fits side by side: each is many short jobs."""
    return OneVsRest(parallelism=len(CLASS_ORDER), classifier=LinearSVC(maxIter=iterations, tol=TOLERANCE, standardization=False, regParam=1.0 / max(1, n_rows), weightCol="weight"), weightCol="weight", labelCol="label")


CLASSIFIERS: Mapping[str, Callable[..., Estimator | DeepForest]] = {"nb": nb, "logreg": logreg, "rf": rf, "svm": svm}


def prepare(df: DataFrame, seed: int = 42) -> DataFrame:
    """(id, text, label, weight, split) from (id, text, canonical_label): labels as numbers in class order, weights that balance the classes, an exact stratified split."""
    split = stratified_split(df, "canonical_label", CLASS_ORDER, hash_order(seed, F.col("id")))
    weights = balanced_weights(split, "canonical_label").drop("n")
    return split.join(F.broadcast(weights), "canonical_label").withColumn("label", label_id(F.col("canonical_label")).cast("double"))


def predictions(model: Transformer | DeepForestModel, df: DataFrame) -> DataFrame:
    """(id, split, true_label, predicted_label)."""
    name = lambda c: F.get(F.array(*map(F.lit, CLASS_ORDER)), F.col(c).cast("int"))
    return model.transform(df).select("id", "split", name("label").alias("true_label"), name("prediction").alias("predicted_label"))


def _tasks(spark: SparkSession, n_rows: int) -> int:
    """Tasks of an iteration over so many rows: as many as the rows ask for, and no more than TASKS or the cores, whichever are more."""
    return max(1, min(max(TASKS, spark.sparkContext.defaultParallelism), -(-n_rows // ROWS_A_TASK)))


@dataclass(frozen=True)
class Settings:
    """What the operators are run with where a caller doesn't take their own defaults."""

    encoder: Mapping[str, object] = field(default_factory=dict)
    classifier: Mapping[str, object] = field(default_factory=dict)


def _settings(settings: Mapping[str, object] | None) -> Settings:
    given = dict(settings or {})
    return Settings({k: v for k, v in given.items() if k in ("vocabulary", "dimensions")}, {k: v for k, v in given.items() if k in ("trees", "depth", "iterations")})


def encoded(df: DataFrame, stages: Iterable[Transformer | Estimator]) -> tuple[DataFrame, list[DataFrame]]:
    """(df behind the stages, each fitted on its training rows; what is kept meanwhile). Counts are kept for the stages that are fitted after them, so that no text is read again for these."""
    stages, kept = list(stages), []
    for k, stage in enumerate(stages):
        model = stage.fit(df.filter("split = 'train'")) if isinstance(stage, Estimator) else stage
        df = model.transform(df)
        if isinstance(stage, _Counts) and any(isinstance(s, Estimator) for s in stages[k + 1 :]):
            df = df.drop("text", "words", "pairs", "grams").persist()
            kept.append(df)
    return df, kept


def evaluate(df: DataFrame, encoder: str, classifier: str, settings: Mapping[str, object] | None = None) -> tuple[DataFrame, float]:
    """(predictions on validation and test, seconds of encoding and fitting) of one combination."""
    (_, _, out, fitted, _) = next(_evaluated(df, encoder, [classifier], settings))
    return out, fitted


def _evaluated(df: DataFrame, encoder: str, classifiers: Iterable[str], settings: Mapping[str, object] | None) -> Iterator[tuple[str, str, DataFrame, float, float]]:
    """(encoder, classifier, predictions, seconds of encoding and fitting, seconds of predicting) of each classifier on one encoding, which is kept as long as it is needed. Predictions are written to the shared folder."""
    shared_dir(df.sparkSession)
    own = _settings(settings)
    began = time.time()
    behind, kept = encoded(df, ENCODERS[encoder](**own.encoder))
    rows = behind.select("id", "split", "label", "weight", "features").persist()
    try:
        n_train = rows.groupBy("split").count().filter("split = 'train'").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]  # all rows are read, so that all are kept
        for step in kept:
            step.unpersist()
        encoding = time.time() - began
        for c in classifiers:
            began = time.time()
            seen = rows.filter("split = 'train'")
            # each iteration is a job: tasks of fewer rows would be all overhead, and more tasks than cores only move more
            seen = seen.coalesce(_tasks(df.sparkSession, n_train)) if c in ITERATIVE else seen
            model = CLASSIFIERS[c](sparse=encoder in SPARSE, n_rows=n_train, **own.classifier).fit(seen)
            fitted = time.time()
            out = predictions(model, rows.filter("split != 'train'")).checkpoint()
            yield encoder, c, out, encoding + fitted - began, time.time() - fitted
    finally:
        rows.unpersist()


#: A row of the results, and a cell of the confusions.
RESULT = "dataset string, encoder string, classifier string, n_train long, n_val long, n_test long, val_macro_f1 double, val_accuracy double, test_macro_f1 double, test_accuracy double, test_f1_ham double, test_f1_spam double, test_f1_smishing double, fit_time_s double, predict_time_s double"
CELL = "dataset string, encoder string, classifier string, true_label string, predicted_label string, count long"


def run_grid(df: DataFrame, encoders: Iterable[str] = tuple(ENCODERS), classifiers: Iterable[str] = tuple(CLASSIFIERS), done: Iterable[tuple[str, str]] = (), settings: Mapping[str, object] | None = None, dataset: str = "all") -> Iterator[tuple[dict, list[dict]]]:
    """(result, confusion of the test) of each combination that is not done yet, as rows of RESULT and CELL, one after the other, so that a run can stop and go on. Rows of an encoder are encoded once for all its classifiers."""
    skip = set(done)
    sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    for e in encoders:
        todo = [c for c in classifiers if (e, c) not in skip]
        for _, c, out, fit, predict in _evaluated(df, e, todo, settings) if todo else ():
            of = {r["split"]: r for r in scores(out, by=("split",)).collect()}
            value = lambda split, name: of[split][name] if split in of else 0.0  # noqa: B023, E731
            name = {"dataset": dataset, "encoder": e, "classifier": c}
            row = name | {f"n_{s}": sizes.get(s, 0) for s in ("train", "val", "test")} | {f"{s}_{m}": value(s, m) for s in ("val", "test") for m in ("macro_f1", "accuracy")} | {f"test_f1_{k}": value("test", f"f1_{k}") for k in CLASS_ORDER}
            cells = [name | r.asDict() for r in confusion(out.filter("split = 'test'")).collect()]
            yield row | {"fit_time_s": fit, "predict_time_s": predict}, cells


def write_grid(df: DataFrame, folder: str, settings: Mapping[str, object] | None = None, dataset: str = "all", **grid: Iterable[str]) -> DataFrame:
    """Runs what a folder's results lack, appends each combination's result and confusion as it ends, and returns all results, the best test macro F1 first."""
    spark = df.sparkSession
    results, confusions = f"{folder.rstrip('/')}/results", f"{folder.rstrip('/')}/confusion_matrices"
    done = [(r["encoder"], r["classifier"]) for r in read_results(spark, results).filter(F.col("dataset") == dataset).collect()] if exists(spark, results) else []
    for row, cells in run_grid(df, done=done, settings=settings, dataset=dataset, **grid):
        append_rows(spark.createDataFrame(cells, CELL), confusions)
        append_rows(spark.createDataFrame([row], RESULT), results)  # last: a result stands for a whole combination
    return read_results(spark, results).orderBy("dataset", F.desc("test_macro_f1"), "encoder", "classifier")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("header", True).csv(path)


def scored_predictions(results: DataFrame, dataset: str, by: tuple[str, ...] = ("model_key",)) -> tuple[DataFrame, DataFrame]:
    """(results, confusions) of a table of predictions made elsewhere, such as fine-tuned transformers': true_label, predicted_label and the columns in by. Confusions have every cell of every group."""
    named = lambda df: df.withColumn("dataset", F.lit(dataset))
    return named(scores(results, by=by)), named(confusion(results, by=by))
