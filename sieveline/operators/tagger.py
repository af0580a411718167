"""Spans of private data by a linear-chain tagger: hashed features of tokens, an averaged perceptron, Viterbi decoding.

Tokens get tags that say where a label's span begins, goes on and ends, or is one token (B, I, E, S), or that there is
none (O); only sequences of tags that make whole spans can be decoded. Training mixes parameters: in each pass every
task goes through its examples from the same weights, and what the tasks have changed is averaged by their examples.
The weights are a table of a stated size, 2^bits features by four tags a label and one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import MODEL_TOKENS, prepare

LABELS = tuple(MODEL_TOKENS)
#: Hashed features, passes over the examples, and how many of them a task has.
BITS, PASSES, EXAMPLES_A_TASK = 16, 6, 500
#: Tokens that are decoded at a time; longer texts are decoded in such stretches, cut behind a token without a span in a stretch's second half.
STRETCH = 4096

_TOKEN = re.compile(r"\w+|[^\w\s]")
Span = tuple[int, int, str]


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> str:
    """Capitals, letters, digits and marks, each run shortened to two."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:40])
    return re.sub(r"(.)\1{2,}", r"\1\1", kinds)


def features(words: Sequence[str], bits: int = BITS) -> np.ndarray:
    """(tokens, features): places of each token's features in the table."""
    low, shapes = [w.lower() for w in words], [_shape(w) for w in words]
    at = lambda x, k: x[k] if 0 <= k < len(x) else "^" if k < 0 else "$"
    mask, rows = (1 << bits) - 1, []
    for k, w in enumerate(low):
        said = (
            "1", f"w{w}", f"s{shapes[k]}", f"p{w[:3]}", f"e{w[-3:]}", f"l{at(low, k - 1)}", f"r{at(low, k + 1)}", f"m{at(low, k - 2)}",
            f"a{at(shapes, k - 1)}|{shapes[k]}", f"b{shapes[k]}|{at(shapes, k + 1)}", f"c{at(low, k - 1)}|{shapes[k]}", f"d{at(low, k - 2)}|{at(low, k - 1)}",
        )
        rows.append([zlib.crc32(x.encode()) & mask for x in said])
    return np.array(rows, np.int64).reshape(len(rows), 12)


def tags_of(places: Sequence[tuple[int, int]], spans: Sequence[Span], labels: Sequence[str]) -> np.ndarray:
    """The tag of each token: 0, or 1 to 4 (B, I, E, S) plus four times its label's place. Of spans that overlap the first, and of these the longest, counts; labels that are none of `labels` don't."""
    out, free = np.zeros(len(places), np.int64), 0
    for a, b, label in sorted(spans, key=lambda s: (s[0], -s[1])):
        inside = [k for k, (x, y) in enumerate(places) if x < b and y > a and k >= free]
        if label in labels and inside:
            base = 4 * labels.index(label)
            out[inside] = base + 2
            out[inside[0]], out[inside[-1]] = base + 1, base + 3
            if len(inside) == 1:
                out[inside[0]] = base + 4
            free = inside[-1] + 1
    return out


def spans_of(tags: Sequence[int], places: Sequence[tuple[int, int]], labels: Sequence[str]) -> list[Span]:
    out, start = [], 0
    for k, tag in enumerate(tags):
        kind = (tag - 1) % 4 if tag else -1
        if kind in (0, 3):
            start = k
        if kind in (2, 3):
            out.append((places[start][0], places[k][1], labels[(tag - 1) // 4]))
    return out


def steps(n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What may follow a tag, begin a text and end it: 0, and minus infinity for what may not."""
    n = 4 * n_labels + 1
    kind, label = (np.arange(n) - 1) % 4, (np.arange(n) - 1) // 4
    outside = (np.arange(n) == 0) | (kind >= 2)
    begins = (np.arange(n) == 0) | (kind == 0) | (kind == 3)
    kind[0], label[0] = 9, -1
    follows = (outside[:, None] & begins[None, :]) | (~outside[:, None] & np.isin(kind, (1, 2))[None, :] & (label[:, None] == label[None, :]))
    return tuple(np.where(x, 0.0, -np.inf) for x in (follows, begins, outside))


def decode(emitted: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best whole sequence of tags. emitted: (tokens, tags); moves: scores of one tag after another, with minus infinity for what can't be."""
    n = len(emitted)
    if not n:
        return np.zeros(0, np.int64)
    back = np.zeros((n, emitted.shape[1]), np.int16)
    score = emitted[0] + first
    for k in range(1, n):
        every = score[:, None] + moves
        back[k] = every.argmax(axis=0)
        score = every[back[k], np.arange(len(score))] + emitted[k]
    out = np.zeros(n, np.int64)
    out[-1] = int((score + last).argmax())
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


@dataclass(frozen=True)
class SpanTagger:
    """weights: 2^bits rows of features, then a row for each tag that another follows; a column for each tag."""

    weights: np.ndarray
    labels: tuple[str, ...] = LABELS
    bits: int = BITS

    def spans(self, text: str) -> list[Span]:
        """Spans of a text as `prepare` gives it, ascending and apart."""
        places = tokens(text)
        allowed, first, last = steps(len(self.labels))
        moves, out, at = allowed + self.weights[1 << self.bits :], [], 0
        while at < len(places):
            part = places[at : at + STRETCH]
            # features look at two tokens before and one behind
            before = min(at, 2)
            around = [text[a:b] for a, b in places[at - before : at + STRETCH + 1]]
            emitted = self.weights[features(around, self.bits)[before : before + len(part)]].sum(axis=1)
            if at:
                emitted[0] += self.weights[1 << self.bits]  # behind a token without a span
            tags = decode(emitted, moves, first, last)
            keep = len(part)
            if at + keep < len(places):  # cut behind the first token without a span in the stretch's second half, if there is one
                outside = np.flatnonzero(tags[STRETCH // 2 :] == 0)
                keep = STRETCH // 2 + int(outside[0]) + 1 if len(outside) else keep
            out += spans_of(tags[:keep], part, self.labels)
            at += keep
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """The weights that are not zero, as Parquet."""
        place, tag = np.nonzero(self.weights)
        held = pd.DataFrame({"place": place, "tag": tag, "weight": self.weights[place, tag].astype(np.float64)})
        rows = spark.createDataFrame(held, "place long, tag long, weight double")
        rows.select("*", F.lit(",".join(self.labels)).alias("labels"), F.lit(self.bits).alias("bits")).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SpanTagger:
        """A model that was saved; it has as many rows as it has weights, and the driver holds it."""
        rows = spark.read.parquet(path).toPandas()
        if not len(rows):
            raise ValueError(f"{path} holds no weights")
        labels, bits = tuple(rows["labels"][0].split(",")), int(rows["bits"][0])
        weights = _table(labels, bits)
        weights[rows["place"], rows["tag"]] = rows["weight"]
        return SpanTagger(weights, labels, bits)


def _table(labels: Sequence[str], bits: int) -> np.ndarray:
    n = 4 * len(labels) + 1
    return np.zeros(((1 << bits) + n, n), np.float32)


def passed(weights: np.ndarray, bits: int, examples: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights after a pass over examples, their average over the pass). examples: (features, tags) of one text each."""
    labels = (weights.shape[1] - 1) // 4
    allowed, first, last = steps(labels)
    own, late = weights.astype(np.float64), np.zeros(weights.shape)
    for done, (places, gold) in enumerate(examples):
        guess = decode(own[places].sum(axis=1), allowed + own[1 << bits :], first, last)
        for tags, sign in ((gold, 1.0), (guess, -1.0)):
            wrong = np.flatnonzero(gold != guess)
            for table, amount in ((own, sign), (late, sign * done)):
                np.add.at(table, (places[wrong], tags[wrong, None]), amount)
                moved = np.flatnonzero((gold[1:] != guess[1:]) | (gold[:-1] != guess[:-1]))
                np.add.at(table, ((1 << bits) + tags[moved], tags[moved + 1]), amount)
    return own, own - late / max(1, len(examples))


def train(examples: DataFrame, labels: Sequence[str] = LABELS, bits: int = BITS, passes: int = PASSES, a_task: int = EXAMPLES_A_TASK, text_col: str = "text", spans_col: str = "spans") -> SpanTagger:
    """A tagger from labelled texts: spans array<struct<start,end,label>>, places in the text as `prepare` gives it.

    Null texts are left out, null spans are none, and rows may repeat. No examples give a tagger that finds nothing.
    Which task has an example, and in what order, goes by a hash of its text, so that reruns agree. The driver holds
    the table of weights, and of a pass the entries that changed.
    """
    labels = tuple(labels)
    rows = examples.select(F.col(text_col).alias("text"), F.col(spans_col).alias("spans")).filter(F.col("text").isNotNull())
    tasks = max(1, -(-rows.count() // a_task))
    dealt = rows.repartition(tasks, F.xxhash64("text")).sortWithinPartitions(F.xxhash64("text", F.lit(1)), "text")
    weights = _table(labels, bits)
    mean = np.zeros(weights.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = prepare(text)
                places = tokens(said)
                given = [(s["start"], s["end"], s["label"]) for s in spans or () if s is not None]
                held.append((features([said[a:b] for a, b in places], bits), tags_of(places, given, labels)))
        if not held:
            return
        after, average = passed(weights, bits, held)
        place, tag = np.nonzero((after != weights) | (average != weights))
        n, gained, meant = len(held), after[place, tag] - weights[place, tag], average[place, tag] - weights[place, tag]
        place, tag, gained, meant = np.r_[-1, place], np.r_[-1, tag], np.r_[1.0, gained], np.r_[1.0, meant]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(tag), pa.array(n * gained), pa.array(n * meant)], ["place", "tag", "gained", "meant"])

    for _ in range(passes):
        found = dealt.mapInArrow(run, "place long, tag long, gained double, meant double").groupBy("place", "tag").agg(F.sum("gained").alias("gained"), F.sum("meant").alias("meant")).toPandas()
        every = found.loc[found["place"] < 0, "gained"].sum()
        found = found[found["place"] >= 0]
        mean += weights
        if every:
            mean[found["place"], found["tag"]] += found["meant"] / every
            weights = weights.copy()  # what runs holds the one before
            weights[found["place"], found["tag"]] += found["gained"] / every
    return SpanTagger((mean / max(1, passes)).astype(np.float32), labels, bits)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))


def span_column(model: object) -> Callable[[Column], Column]:
    """A column of a model's spans, for texts as they are before `prepare`. model: anything with spans(text), a tagger or a rule."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "label": label} for a, b, label in model.spans(prepare(t))])

    return found


def span_scores(rows: DataFrame, found: str = "found", gold: str = "spans") -> DataFrame:
    """(label, n_found, n_gold, n_both, precision, recall, f1) by label, and of all (label null), over spans that agree in both places and in label."""
    one = lambda c, k: rows.select(F.explode(F.array_distinct(F.coalesce(c, F.array().cast(SPANS)))).alias("s"), F.lit(k).alias("k"))
    each = one(F.col(found), "found").unionByName(one(F.col(gold).cast(SPANS), "gold")).unionByName(one(F.array_intersect(F.col(found), F.col(gold).cast(SPANS)), "both"))
    counts = each.rollup(F.col("s.label").alias("label")).agg(*[F.count_if(F.col("k") == k).alias(f"n_{k}") for k in ("found", "gold", "both")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = {k: F.col(f"n_{k}") for k in ("found", "gold", "both")}
    return counts.select("*", ratio(n["both"], n["found"]).alias("precision"), ratio(n["both"], n["gold"]).alias("recall"), ratio(2 * n["both"], n["found"] + n["gold"]).alias("f1"))
