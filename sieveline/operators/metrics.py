"""Confusion matrices over a complete grid, and what follows from them: accuracy, F1 of each class, macro F1, by slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLASS_ORDER


def confusion(df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", by: tuple[str, ...] = (), classes: tuple[str, ...] = CLASS_ORDER) -> DataFrame:
    """(*by, true_label, predicted_label, count): every cell of every slice, also those without rows.

    Each slice's cells are counted as one map of at most classes x classes entries, and laid out in the order of classes.
    """
    cells = [(t, p) for t in classes for p in classes]
    counted = df.groupBy(*by).agg(*[F.count_if((F.col(true) == t) & (F.col(predicted) == p)).alias(f"_{k}") for k, (t, p) in enumerate(cells)])
    grid = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(f"_{k}").alias("count")) for k, (t, p) in enumerate(cells)])
    return counted.select(*by, F.explode(grid).alias("cell")).select(*by, "cell.*")


def scores(df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", by: tuple[str, ...] = (), classes: tuple[str, ...] = CLASS_ORDER) -> DataFrame:
    """(*by, n_samples, accuracy, macro_f1, f1_<class>...): a class that occurs on neither side scores 0, and macro F1 is the mean over all classes, whatever a slice holds."""
    both = lambda c: F.count_if((F.col(true) == c) & (F.col(predicted) == c))
    either = lambda c: F.count_if(F.col(true) == c) + F.count_if(F.col(predicted) == c)
    got = df.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"), *[both(c).alias(f"_b_{c}") for c in classes], *[either(c).alias(f"_e_{c}") for c in classes])
    f1 = {c: F.when(F.col(f"_e_{c}") > 0, 2 * F.col(f"_b_{c}") / F.col(f"_e_{c}")).otherwise(0.0) for c in classes}
    macro = sum(f1.values(), F.lit(0.0)) / len(classes)
    return got.select(*by, "n_samples", "accuracy", macro.alias("macro_f1"), *[f1[c].alias(f"f1_{c}") for c in classes])


def class_distribution(df: DataFrame, label: str, classes: tuple[str, ...] = CLASS_ORDER) -> DataFrame:
    """One row: n, and the rows of each class, 0 where there are none."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(c) for c in classes])


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows over classes times rows of the class. One row a class, to be joined by broadcast."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # over one row a class
    return counts.select(label, "n", (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"))
