"""A curriculum over sources: each source's weight changes over training, and every document gets its place in time.

A source's schedule is a piecewise linear weight over training time 0 to 1. Its integral, scaled to the source's
target, is the demand for its words up to a time; a document that begins at word u of its source's stream is placed
at the time when the demand reaches u. The stream of a source is its documents in the order of a seeded hash, once
or several times over, and ends at the target: the last document is taken in part.

Sums along a stream take two steps, slices of the hash first, so that no task holds a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, n_words

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules in the same order: weights at the times 0, 1/2 and 1, relative to the source's own mean.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Adds rank, weight, target to (source, source_size): `share` of all words by weight, a source at most `most` times its own; what is over goes to the others by weight until none is above.

    That ends at one level for all sources below their limit, found by one pass in the order of limit over weight.
    The windows run over one row a source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by = [F.col("limit") / F.col("weight"), F.col("rank")]
    upto, after = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*by).rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    # the first source, in this order, whose limit is above the level sets it for itself and all after it
    found = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(*by, F.col("level")))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(found["level"] * F.col("weight"), F.col("limit")))
    return leveled.withColumn("target", F.round(F.greatest(target, F.lit(0.0)), 6)).drop("limit", "level")


def invert(share: Column, schedule: Column) -> Column:
    """The time when the demand of a schedule with weights at 0, 1/2 and 1 reaches this share of its whole."""
    a, b, c = schedule[0], schedule[1], schedule[2]
    first, second = (a + b) / 4, (b + c) / 4
    need = share * (first + second)

    def within(start: Column, end: Column, rest: Column) -> Column:
        # start * x + (end - start) * x * x = rest, over a half from x = 0 to 1/2
        slope = end - start
        speed = start + F.sqrt(F.greatest(start * start + 4 * slope * rest, F.lit(0.0)))
        return F.when(speed > 0, 2 * rest / speed).otherwise(0.0)

    return F.when(need <= first, within(a, b, need)).otherwise(0.5 + within(b, c, need - first))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = 17, slice_rows: int = 250, carry: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, source, copies, position (of its first copy, null if none), positions.

    carry: columns of docs, by the names that they get, which come along through the one exchange that the running
    sums need; docs is then read twice, and must give the same rows in the same partitions both times, as tables do.
    The order of the rows is left to the caller.

    Null texts have size 0; null sources are a source, the last; null ids stay; repeated rows are documents of
    their own, which may change places among themselves. A document without words takes nothing
    and has no position. An empty table gives no rows. A very long text costs its length once for its words and its
    checksum. Other columns are not looked at.
    """
    carry = dict(carry or {})
    placed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("long").cast("string"), F.col(text_col))).alias("h"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(name) for name, c in carry.items()],
    )
    rows = cut(placed.drop(*carry))
    placed = placed if carry else rows  # what is carried is read once more rather than written
    n = rows.count()
    # slices are ranges of the hash, so that the order is the hash's whatever their number; there are about as many as a slice has rows, where these are more than slice_rows
    room = max(slice_rows, math.isqrt(n))
    slices = max(1, n // room)
    # equal rows, which no hash tells apart: a hash with more rows than a slice should have is dealt to slices of its own by the rows' places; there are n / room such hashes at most, no more than the root of n where that is large
    many = cut(rows.groupBy("source", "h").agg(F.count("*").alias("rows")).filter(F.col("rows") > room))
    # a null-safe comparison would be one of other keys than the window's, and so a second exchange of what is carried
    named, none = F.coalesce("source", F.lit("")), F.col("source").isNull()
    slice_of = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(slices), 32)
    hot = many.groupBy(named.alias("hot_s"), none.alias("hot_t"), slice_of.alias("hot_k")).agg(F.sort_array(F.collect_list(F.struct("h", F.ceil(F.col("rows") / room).alias("parts")))).alias("hot"))

    def sliced(df: DataFrame) -> DataFrame:
        """With named, none and slice, a struct of three numbers in the order of the hash: the hash's range, the place before, at or after a hash of many rows in it, and the part of these."""
        df = df.withColumn("named", named).withColumn("none", none).withColumn("k", slice_of)
        df = df.join(F.broadcast(hot), (F.col("named") == F.col("hot_s")) & (F.col("none") == F.col("hot_t")) & (F.col("k") == F.col("hot_k")), "left")
        own = F.get(F.filter("hot", lambda x: x["h"] == F.col("h")), F.lit(0))["parts"]
        at = F.coalesce(2 * F.size(F.filter("hot", lambda x: x["h"] < F.col("h"))) + F.when(own.isNotNull(), 1).otherwise(0), F.lit(0))
        part = F.coalesce(F.pmod(F.col("row"), own), F.lit(0))
        return df.withColumn("slice", F.struct(F.col("k").alias("k"), F.when(F.col("hot").isNull(), 0).otherwise(at).cast("long").alias("at"), part.cast("long").alias("part"))).drop("hot_s", "hot_t", "hot_k", "hot", "k")

    sizes = sliced(rows).groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = cut(sizes.withColumn("before", F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")))
    targets = source_targets(before.groupBy("source").agg(F.sum("slice_size").alias("source_size")), share, most, weights)
    kinds = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    targets = targets.withColumn("schedule", F.element_at(kinds, (F.col("rank") % len(schedules) + 1).cast("int")))
    offsets = before.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).select(named.alias("s"), none.alias("t"), F.col("slice").alias("k"), "before", "source_size", "target", "schedule")
    stream = sliced(placed)
    stream = stream.withColumn("upto", F.sum("size").over(Window.partitionBy("named", "none", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    joined = stream.join(offsets, (F.col("named") == F.col("s")) & (F.col("none") == F.col("t")) & (F.col("slice") == F.col("k")))
    start = F.col("before") + F.col("upto") - F.col("size")
    limit = F.floor("target")
    starts = F.transform(F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1))), lambda k: start + k * F.col("source_size"))
    starts = F.filter(starts, lambda u: (u < limit) & (F.col("size") > 0))
    joined = joined.withColumn("starts", starts).withColumn("limit", limit)
    taken = F.aggregate("starts", F.lit(0).cast("long"), lambda acc, u: acc + F.least(F.col("size"), F.col("limit") - u))
    positions = F.transform("starts", lambda u: F.round(invert(u / F.col("target"), F.col("schedule")), 9))
    out = joined.withColumn("taken", taken).withColumn("positions", positions).withColumn("copies", F.size("starts"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", F.get("positions", F.lit(0)).alias("position"), "positions", *carry)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of `mix` range-sorted by position; documents without one come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as often as the mix takes them, range-sorted by position, all columns as they are.

    Texts move twice: to their slice, and to their place. No key but the slice, some thousand rows of a hash order,
    gathers rows, and repeated rows are dealt to slices of their own, so that neither they nor hot sources make a task
    longer. Documents that the mix leaves out, those
    without words among them, have no row. Null ids, texts and sources are dealt with as in `mix`; columns may have any
    names; an empty table gives no rows.
    """
    names = {free_name(docs, f"_mix_{k}"): c for k, c in enumerate(docs.columns)}
    place = free_name(docs, "_mix_place")
    taken = mix(docs, carry=names, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = taken.select(F.explode("positions").alias(place), *names)
    return copies.repartitionByRange(place).sortWithinPartitions(place).select(*[F.col(n).alias(c) for n, c in names.items()])


#: The rows of `mix` over documents with its parameters as they are, in DuckDB's SQL.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), text)) AS h FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS lim FROM a),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, lim / weight) AS level FROM l WHERE level <= lim / weight),
t AS (SELECT source, source_size, rank, round(greatest(least(lim, coalesce((SELECT level FROM f) * weight, lim)), 0), 6) AS target FROM l),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.rank, CAST(floor(t.target) AS BIGINT) AS stop, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS first FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN size > 0 AND first < stop THEN 1 ELSE 0 END + CASE WHEN size > 0 AND first + source_size < stop THEN 1 ELSE 0 END AS copies, CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS w2, first / target AS share FROM c),
q AS (SELECT *, share * ((w0 + 1) / 4 + (1 + w2) / 4) AS need FROM p)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE least(size, greatest(stop - first, 0)) + least(size, greatest(stop - first - source_size, 0)) END AS BIGINT) AS taken, copies,
round(CASE WHEN copies = 0 THEN NULL WHEN need <= (w0 + 1) / 4 THEN 2 * need / (w0 + sqrt(greatest(w0 * w0 + 4 * (1 - w0) * need, 0))) ELSE 0.5 + 2 * (need - (w0 + 1) / 4) / (1 + sqrt(greatest(1 + 4 * (w2 - 1) * (need - (w0 + 1) / 4), 0))) END, 9) AS position FROM q"""
