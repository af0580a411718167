"""Exact samples: rows in the order of a seeded hash, quotas by largest remainder.

Ranks come in two steps, counts of hash slices before ranks within a slice, so that a class with most of the rows
is not ranked in one task. Ranks are the same as those of one window over each class.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the hash order: its first four digits, so that a slice is a 65,536th of a class, and a class's slices are one short window.
SLICE = 4


def hash_order(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def ranked(df: DataFrame, by: list[str], order: Column, rank: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row among the rows of equal `by`, in ascending order of a hash text."""
    rows = df.withColumn("_h", order).withColumn("_s", F.substring("_h", 1, SLICE))
    before = rows.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # nulls in `by` are a group too
    before = before.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_s").alias("_slice_key"), "_before")
    inner = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_h")))
    same = F.col("_s") == F.col("_slice_key")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return inner.join(before, same).withColumn(rank, (F.col("_r") + F.col("_before")).cast("long")).select(*df.columns, rank)


def class_cap(df: DataFrame, label: str, capped: str, by: str, cap: int, order: Column) -> DataFrame:
    """At most `cap` rows of one label from each source; other labels whole."""
    few = ranked(df.filter(F.col(label) == capped), [by], order).filter(F.col("rank") <= cap).drop("rank")
    return df.filter(F.col(label) != capped).unionByName(few)


def largest_remainder(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """`total` shared in proportion to the counts: whole parts first, then one each by descending remainder, ties by the order given."""
    everything = sum(counts.values())
    if not everything:
        return dict.fromkeys(counts, 0)
    out = {k: total * n // everything for k, n in counts.items()}
    spare = sorted(counts, key=lambda k: -(total * counts[k] % everything))
    for k in spare[: total - sum(out.values())]:
        out[k] += 1
    return out


def split_quotas(counts: Mapping[str, int], fraction: tuple[int, int] = (1, 5)) -> dict[str, tuple[int, int, int]]:
    """Rows of each class for train, validation and test: a fifth goes off, rounded up, and is halved, the larger half for the test."""
    n = sum(counts.values())
    off = -(-n * fraction[0] // fraction[1])
    away = largest_remainder(counts, off)
    test = largest_remainder(away, -(-off // 2))
    return {k: (counts[k] - away[k], away[k] - test[k], test[k]) for k in counts}


def class_counts(df: DataFrame, label: str, classes: tuple[str, ...]) -> dict[str, int]:
    """Rows of each class, in the order of classes: as many rows come to the driver."""
    got = {r[label]: r["count"] for r in df.filter(F.col(label).isin(*classes)).groupBy(label).count().collect()}
    return {c: got.get(c, 0) for c in classes}


def stratified_split(df: DataFrame, label: str, classes: tuple[str, ...], order: Column) -> DataFrame:
    """Adds `split`: train, val or test, with exact quotas for each class."""
    quotas = split_quotas(class_counts(df, label, classes))
    split = F.lit(None).cast("string")
    for c, (train, val, _) in quotas.items():
        split = F.when(F.col(label) == c, F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")).otherwise(split)
    return ranked(df.filter(F.col(label).isin(*classes)), [label], order).withColumn("split", split).drop("rank")


def stratified_sample(df: DataFrame, label: str, n: int, order: Column, classes: tuple[str, ...]) -> DataFrame:
    """Exactly n rows, or all if there are no more: whole parts of each class's share, and the rest in hash order from what is left, rows without a class among them."""
    total = df.count()
    if n >= total:
        return df
    counts = class_counts(df, label, classes)
    quota = F.lit(0)
    for c, k in counts.items():
        quota = F.when(F.col(label) == c, n * k // total).otherwise(quota)
    rows = ranked(df, [label], order).withColumn("_in", F.coalesce(F.col("rank") <= quota, F.lit(False))).drop("rank")
    short = n - sum(n * k // total for k in counts.values())
    fill = ranked(rows.filter(~F.col("_in")).withColumn("_all", F.lit(0)), ["_all"], order).filter(F.col("rank") <= short)
    return rows.filter("_in").select(*df.columns).unionByName(fill.select(*df.columns))
