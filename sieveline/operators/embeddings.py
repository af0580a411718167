"""Word vectors by continuous bags of words with negative sampling, learned by all tasks at once; whole words, or words with their character n-grams.

A word's input vector is the mean of its rows: its own row, and with n-grams also those of the buckets its n-grams hash
to, from which words that training never saw are composed. In each pass every task goes through its texts from the
same two tables, and sends back the rows it changed; rows are averaged over the tasks that changed them, weighted by
how often each did. Tables have a stated size: a capped vocabulary, the buckets, and the dimensions. So has what a pass
moves, as there are a stated number of tasks at most, however many texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the vocabulary at most (the most frequent), times a word must occur, buckets of n-grams, lengths of n-grams.
VOCABULARY, LEAST, BUCKETS, GRAMS = 50_000, 2, 1 << 16, (3, 6)
WINDOW, NEGATIVES, RATE, PASSES = 5, 5, 0.05, 5
#: Texts of a task at least, which are also those it holds at a time; tasks of a pass at most, as each sends back every row it changed; and positions whose gradients are added up before the tables change (fewer for small vocabularies).
TEXTS_A_TASK, TASKS, BATCH = 200, 48, 512
#: How far a batch moves a row at most: rows that very many positions share would run away otherwise.
REACH = 0.25
#: Members of runs that are added up for all runs at once.
RUN = 64
#: Rows of tables that are sent or averaged together.
PART = 4096


def grams_of(word: str, lengths: tuple[int, int] = GRAMS) -> list[str]:
    """The character n-grams of a word between marks for its ends, but not the marked word itself."""
    said = f"<{word}>"
    return [said[k : k + n] for n in range(lengths[0], min(lengths[1], len(said) - 1) + 1) for k in range(len(said) - n + 1)]


@dataclass(frozen=True)
class Rows:
    """Rows of the input table by word: those of word w are places[starts[w]:starts[w + 1]]."""

    starts: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(words: Sequence[str], buckets: int) -> Rows:
        each = [[k, *(len(words) + zlib.crc32(g.encode()) % buckets for g in grams_of(w))] if buckets else [k] for k, w in enumerate(words)]
        return Rows(np.cumsum([0, *map(len, each)]), np.array([p for x in each for p in x], np.int64))

    def flat(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of all these words, which word each belongs to, how many each has)."""
        n = self.starts[words + 1] - self.starts[words]
        owner = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.places[self.starts[words][owner] + at], owner, n


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the different values, ascending, the order that sorts all, where each one's run begins in it, how long it is)."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    return own[first], order, first, np.diff(np.append(first, len(own)))


def _sums(values: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, which runs they are of): the rows values[at[f : f + k]] added up, for each run from f in first and k in n, which is 1 or more.

    Runs of RUN members at most are added up member by member, all runs at once: `reduceat` goes through rows column by column.
    """
    by = np.argsort(-n, kind="stable")
    first, less = first[by], -n[by]
    out = values[at[first]]
    long = int(np.searchsorted(less, -RUN))
    for k in range(1, RUN):
        m = int(np.searchsorted(less, -k))
        if m <= long:
            break
        out[long:m] += values[at[first[long:m] + k]]
    if long:
        size = -less[:long]
        begin = np.cumsum(size) - size
        out[:long] = np.add.reduceat(values[at[np.repeat(first[:long] - begin, size) + np.arange(size.sum())]], begin, axis=0)
    return out, by


def _summed(values: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """`_sums` in the order of the runs."""
    out, by = _sums(values, at, first, n)
    back = np.empty_like(out)
    back[by] = out
    return back


def _moved(table: np.ndarray, at: np.ndarray, by: np.ndarray, place: np.ndarray, reach: float) -> None:
    """Adds to rows of a table the row of `by`, at the place given, that belongs to each, no row by more than `reach`."""
    own, order, first, n = _runs(at)
    total, which = _sums(by, place[order], first, n)
    size = np.sqrt(np.einsum("bd,bd->b", total, total))
    far = size > reach
    total[far] *= (reach / size[far, None]).astype(total.dtype)
    table[own[which]] += total


def step(inputs: np.ndarray, outputs: np.ndarray, rows: Rows, context: np.ndarray, target: np.ndarray, rate: float, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Changes both tables by one batch, no row by more than `reach`, and returns how often each row of them was changed.

    context: (positions, words around), -1 for none; target: (positions, 1 + negatives), the first being the word itself.
    The loss is that of a logistic regression for each target; a negative that is the word itself doesn't count. As is
    usual for means of context, each row of a word around gets the whole gradient of the mean.
    """
    known = context >= 0
    around = context[known]
    words, order, first, seen = _runs(around)
    place = np.empty(len(around), np.int64)
    place[order] = np.repeat(np.arange(len(words)), seen)
    flat, owner, n = rows.flat(words)
    vectors = _summed(inputs, flat, np.cumsum(n) - n, n) / n[:, None].astype(inputs.dtype)
    at, _ = np.nonzero(known)
    count = known.sum(axis=1)
    hidden = np.zeros((len(context), inputs.shape[1]), inputs.dtype)
    some = count > 0
    hidden[some] = _summed(vectors, place, (np.cumsum(count) - count)[some], count[some]) / count[some, None].astype(inputs.dtype)
    own = outputs[target]
    wanted = np.zeros(target.shape, inputs.dtype)
    wanted[:, 0] = 1
    miss = (wanted - 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", hidden, own), -30, 30)))) * rate
    miss[:, 1:][target[:, 1:] == target[:, :1]] = 0
    back = np.einsum("bk,bkd->bd", miss, own)
    _moved(outputs, target.reshape(-1), (miss[:, :, None] * hidden[:, None, :]).reshape(-1, inputs.shape[1]), np.arange(target.size), reach)
    share = _summed(back, at[order], first, seen)
    _moved(inputs, flat, share, owner, reach)
    return np.bincount(flat, weights=seen[owner], minlength=len(inputs)), np.bincount(target[miss != 0], minlength=len(outputs))


def windows(ids: np.ndarray, width: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """(positions, 2 * most): the words around each, `width` on both sides, -1 where there is none."""
    offsets = np.r_[-most:0, 1 : most + 1]
    at = np.arange(len(ids))[:, None] + offsets
    inside = (at >= 0) & (at < len(ids)) & (np.abs(offsets) <= width[:, None])
    return np.where(inside, ids[np.clip(at, 0, max(0, len(ids) - 1))], -1)


@dataclass(frozen=True)
class Vectors:
    """words: the vocabulary; table: a row a word, then a row a bucket."""

    words: tuple[str, ...]
    table: np.ndarray
    buckets: int = 0
    _known: dict = field(default_factory=dict, repr=False, compare=False)
    _lately: dict = field(default_factory=dict, repr=False, compare=False)

    def word(self, w: str) -> np.ndarray | None:
        """The mean of a word's rows; None for a word that has none. Vectors of words that came up lately are kept."""
        if w not in self._lately:
            if len(self._lately) >= VOCABULARY:
                self._lately.clear()
            self._lately[w] = self._mean(w)
        return self._lately[w]

    def _mean(self, w: str) -> np.ndarray | None:
        if not self._known:
            self._known.update((x, k) for k, x in enumerate(self.words))
        k = self._known.get(w)
        if not self.buckets:
            return None if k is None else self.table[k]
        rows = [len(self.words) + zlib.crc32(g.encode()) % self.buckets for g in grams_of(w)] + ([] if k is None else [k])
        return self.table[rows].mean(axis=0) if rows else None

    def text(self, words: Sequence[str] | None) -> np.ndarray:
        """The mean of the words that have a vector; zeros where there is none."""
        found = [v for w in words or () if (v := self.word(w)) is not None]
        return np.mean(found, axis=0) if found else np.zeros(self.table.shape[1], self.table.dtype)


def _packed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a table of float32."""
    rows = np.ascontiguousarray(rows, np.float32)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (4 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _unpacked(packed: pa.Array, width: int) -> np.ndarray:
    """The table that `_packed` made an array of, as float64."""
    _, offsets, data = packed.buffers()
    begin = int(np.frombuffer(offsets, np.int32)[packed.offset]) if len(packed) else 0
    return np.frombuffer(data, np.float32, len(packed) * width, begin).reshape(-1, width).astype(np.float64)


def vocabulary_of(texts: DataFrame, words_col: str = "words", size: int = VOCABULARY, least: int = LEAST) -> tuple[list[str], np.ndarray]:
    """(words, counts), the most frequent first, ties by word: at most `size` rows come to the driver."""
    counts = texts.select(F.explode(words_col).alias("w")).filter("w != ''").groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "w").limit(size).collect()
    return [r["w"] for r in found], np.array([r["n"] for r in found], np.float64)


def dealt(texts: DataFrame, words_col: str, texts_a_task: int = TEXTS_A_TASK, tasks: int = TASKS) -> DataFrame:
    """The texts of two words and more, dealt by a hash to as many tasks as they ask for, `tasks` at most, and in the hash's order."""
    held = texts.select(F.filter(words_col, lambda w: w.isNotNull()).alias("words")).filter(F.size("words") > 1)
    key = F.xxhash64("words")
    return held.repartition(max(1, min(tasks, -(-held.count() // texts_a_task))), key).sortWithinPartitions(key)


def numbered(texts: DataFrame, words_col: str, known: dict[str, int]) -> DataFrame:
    """(words array<int>): the places in the vocabulary of each text's words; words that it lacks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_A_TASK):
                said = batch.column(0).slice(k, TEXTS_A_TASK).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([[known[w] for w in x or () if w in known] for x in said], pa.list_(pa.int32()))], ["words"])

    return texts.select(words_col).mapInArrow(run, "words array<int>")


def _some_texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The texts of a task, `most` at a time, however they arrive."""
    held: list[np.ndarray] = []
    for b in batches:
        for k in range(b.num_rows):
            held.append(b.column(0)[k].values.to_numpy().astype(np.int64))
            if len(held) == most:
                yield held
                held = []
    if held:
        yield held


def averaged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(kind, row, v): the sum of each row's vectors over that of its n. Rows come sorted, so that those of a part of a batch and the last one before are held at a time."""
    at, n, total = np.zeros((2, 0), np.int64), np.zeros(0), np.zeros((0, width))

    def taken(m: int | None) -> Iterator[pa.RecordBatch]:
        if len(n[:m]):
            means = _packed((total[:m] / n[:m, None]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(at[0, :m], pa.int32()), pa.array(at[1, :m]), means], ["kind", "row", "v"])

    for b in batches:
        for k in range(0, b.num_rows, PART):
            part = b.slice(k, PART)
            # the last row of the part before may go on
            own = np.concatenate([at, [part.column(0).to_numpy(), part.column(1).to_numpy()]], axis=1).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
            n = np.add.reduceat(np.append(n, part.column(2).to_numpy()), first)
            size = np.diff(np.append(first, own.shape[1]))
            total = _summed(np.concatenate([total, _unpacked(part.column(3), width)]), np.arange(own.shape[1]), first, size)
            at = own[:, first]
            yield from taken(-1)
            at, n, total = at[:, -1:], n[-1:], total[-1:]
    yield from taken(None)


def learn(texts: DataFrame, words_col: str = "words", dimensions: int = 100, buckets: int = 0, passes: int = PASSES, vocabulary: int = VOCABULARY, least: int = LEAST, window: int = WINDOW, negatives: int = NEGATIVES, rate: float = RATE, texts_a_task: int = TEXTS_A_TASK, seed: int = 42) -> Vectors:
    """Vectors from rows of words (array<string>). buckets: 0 for whole words alone.

    Null rows, null words and empty ones are left out; so are words beyond the vocabulary, as if the text did not have
    them. Texts are dealt to tasks by a hash, so that reruns agree; they are kept as numbers of words for all passes. A
    task holds both tables and texts_a_task of its texts at a time; the driver holds the tables.
    """
    words, counts = vocabulary_of(texts, words_col, vocabulary, least)
    known = {w: k for k, w in enumerate(words)}
    rows = Rows.of(words, buckets)
    rng = np.random.default_rng(seed)
    inputs = ((rng.random((len(words) + buckets, dimensions)) - 0.5) / dimensions).astype(np.float32)
    outputs = np.zeros((len(words), dimensions), np.float32)
    if not words:
        return Vectors((), inputs, buckets)
    noise = np.cumsum(counts**0.75)
    spread = dealt(numbered(texts, words_col, known), "words", texts_a_task).persist()
    tasks = spread.rdd.getNumPartitions()
    share = max(1.0, spread.count() / tasks)
    batch = max(16, min(BATCH, 2 * len(words)))

    def run(number: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = inputs.copy(), outputs.copy()
            n_a, n_b = np.zeros(len(a)), np.zeros(len(b))
            had = 0
            for mine in _some_texts(batches, texts_a_task):
                own = np.random.default_rng([seed, number, had, len(mine), int(mine[0][0])])
                own.shuffle(mine)
                around = np.concatenate([windows(x, own.integers(1, window + 1, len(x)), window) for x in mine])
                center = np.concatenate(mine)
                for at in range(0, len(center), batch):
                    done = (number + min(1.0, (had + len(mine) * at / len(center)) / share)) / passes
                    drawn = np.searchsorted(noise, own.random((len(center[at : at + batch]), negatives)) * noise[-1], "right")
                    target = np.concatenate([center[at : at + batch, None], np.minimum(drawn, len(words) - 1)], axis=1)
                    x, y = step(a, b, rows, around[at : at + batch], target, rate * max(1e-2, 1 - done))
                    n_a += x
                    n_b += y
                had += len(mine)
            for kind, table, n in ((0, a, n_a), (1, b, n_b)):
                changed = np.flatnonzero(n)
                for k in range(0, len(changed), PART):
                    part = changed[k : k + PART]
                    vectors = _packed((table[part] * n[part, None]).astype(np.float32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind), pa.int32()), pa.array(part), pa.array(n[part]), vectors], ["kind", "row", "n", "v"])

        return task

    for number in range(passes):
        changed = spread.mapInArrow(run(number), "kind int, row long, n double, v binary")
        sent = changed.repartition("kind", "row").sortWithinPartitions("kind", "row")
        means = sent.mapInArrow(lambda batches: averaged(batches, dimensions), "kind int, row long, v binary").toArrow()
        inputs, outputs = inputs.copy(), outputs.copy()
        for kind, table in ((0, inputs), (1, outputs)):
            part = means.filter(pc.equal(means["kind"], kind))
            if part.num_rows:
                table[part["row"].to_numpy()] = np.frombuffer(b"".join(part["v"].to_pylist()), np.float32).reshape(part.num_rows, dimensions)
    spread.unpersist()
    return Vectors(tuple(words), inputs, buckets)


def with_vectors(rows: DataFrame, vectors: Vectors, words_col: str, out: str) -> DataFrame:
    """rows with the vector of each text, the mean over its words; the columns of words and of text stay behind."""
    kept = [c for c in rows.columns if c not in (words_col, "text")]
    shared = rows.sparkSession.sparkContext.broadcast(vectors)  # of a stated size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, words = batch.columns
            means = [shared.value.text(w).astype(np.float64) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([*others, pa.array(means, pa.list_(pa.float64()))], [*kept, "_vector"])

    plain = rows.select(*kept, words_col)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)
    return plain.mapInArrow(run, f"{kinds + ', ' if kinds else ''}_vector array<double>").withColumn(out, array_to_vector("_vector")).drop("_vector")


class WordVectors(Estimator, HasInputCol, HasOutputCol):
    """`learn` as a stage: arrays of words in, vectors of texts out."""

    @keyword_only
    def __init__(self, *, inputCol: str = "words", outputCol: str = "features", options: dict | None = None):  # noqa: N803
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.options = dict(options or {})

    def _fit(self, dataset: DataFrame) -> WordVectorsModel:
        return WordVectorsModel(learn(dataset, self.getInputCol(), **self.options), self.getInputCol(), self.getOutputCol())


class WordVectorsModel(Model):
    def __init__(self, vectors: Vectors, input_col: str, output_col: str):
        super().__init__()
        self.vectors, self.input_col, self.output_col = vectors, input_col, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_vectors(dataset, self.vectors, self.input_col, self.output_col)
