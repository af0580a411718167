"""Best-fit packing of documents into training sequences under several capacities at once.

Documents are tokenised where they are read; only their lengths move. Pieces are dealt into blocks of a bounded
number of pieces by a salt of their place in the input (so that equal rows spread), and each block is packed
by itself: pieces by decreasing size, each into the open sequence that the score selects among those with room in
every capacity. Sequences that stay below `refill` of the token capacity are opened again and packed once more in
blocks `merge` times as large, so that what is lost at the blocks' edges falls with their size, not their number.

Capacities that are wished for but must not cost a sequence (`wished`: fewer documents, less attention) hold in the
first pass of a packing of its own; it is taken where it has no more sequences than the packing without them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoder


@dataclass(frozen=True)
class Capacities:
    """Of one sequence: tokens, documents, and attention cost (the sum of squared piece lengths)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


def best_fit(lengths: np.ndarray, capacities: Capacities, weights=(1.0, 0.1, 0.1), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. score: "norm" takes the bin of least weighted residual norm after the piece, "dot" that of the largest weighted dot product of piece and residual; ties go to the oldest bin. A piece that no empty bin can hold in every capacity gets a bin of its own."""
    n = len(lengths)
    cap, w = capacities.vector(), np.asarray(weights, dtype=np.float64)
    sizes = np.stack([lengths, np.ones(n), np.square(lengths.astype(np.float64))], axis=1) / cap
    order = np.argsort(-(sizes * w).sum(axis=1), kind="stable")
    least = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]  # what the rest needs at least
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_res = np.empty((max(n, 1), 3))
    open_id = np.empty(max(n, 1), np.int64)
    filled = np.zeros(n, np.int64)
    n_open = n_bins = 0
    eps = 1e-12
    for step, i in enumerate(order):
        size = sizes[i]
        if step % 64 == 0 and n_open:
            keep = (open_res[:n_open] + eps >= least[step]).all(axis=1)
            k = int(keep.sum())
            open_res[:k], open_id[:k], n_open = open_res[:n_open][keep], open_id[:n_open][keep], k
        left = open_res[:n_open] - size
        fits = np.flatnonzero((left >= -eps).all(axis=1))
        if fits.size:
            # column by column, so that equal bins score the same to the last digit
            x = left[fits] ** 2 if score == "norm" else -(open_res[fits] * size)
            value = x[:, 0] * w[0] + x[:, 1] * w[1] + x[:, 2] * w[2]
            at = fits[int(np.argmin(value))]
            open_res[at] = left[at]
            b = open_id[at]
        else:
            b, n_bins = n_bins, n_bins + 1
            open_res[n_open], open_id[n_open] = 1.0 - size, b
            n_open += 1
        bins[i], offsets[i] = b, filled[b]
        filled[b] += lengths[i]
    return bins, offsets


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", cache_parts: int | None = None) -> DataFrame:
    """One row for each piece of at most `capacity` ids: only longer documents are cut, into full pieces but the first. cache_parts: parts of texts whose ids a Python worker keeps, the encoder's number unless given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache_parts).encode
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n or k == 0:
                    stop = at + ((n - 1) % capacity + 1 if at == 0 and n else capacity)
                    rows.append((doc, k, at, min(stop, n) - at, zlib.crc32(ids[4 * at : 4 * stop]), salt))
                    at, k = max(stop, 1), k + 1
                salt += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_pieces(items: DataFrame, n_blocks: int, capacities: Capacities, weights=(1.0, 0.1, 0.1), score: str = "norm", base: int = 0) -> DataFrame:
    """Packs each of n_blocks blocks by itself; adds sequence_id, offset and filled (tokens in the sequence)."""

    def run(block: pa.Table) -> pa.Table:
        # Arrow throughout: ids beside nulls stay whole numbers
        block = block.sort_by([("salt", "ascending"), ("piece", "ascending")])
        lengths = block["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacities, weights, score)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        number = (np.int64(block["block"][0].as_py()) << 32) + np.int64(base) + bins
        return block.drop_columns("block").append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("filled", pa.array(filled[bins]))

    blocked = items.withColumn("block", F.pmod(F.xxhash64("salt", "piece"), F.lit(n_blocks)))
    return blocked.groupBy("block").applyInArrow(run, f"{PIECES}, sequence_id long, offset long, filled long")


def pack(docs: DataFrame, tokenizer: str, capacities: Capacities = Capacities(), end_id: int | None = 0, weights=(1.0, 0.1, 0.1), score: str = "norm", block_docs: int = 2048, merge: int = 16, refill: float = 0.999, wished: Capacities | None = None, id_col: str = "doc_id", text_col: str = "text", cache_parts: int | None = None) -> DataFrame:
    """Packs documents into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone. Null ids stay null, whatever ids stand beside them, and
    repeated rows are packed as rows of their own; pieces of equal size keep the order of the input. A very long text
    is encoded in one go by one task, about 20 bytes of memory a character, and its pieces are spread like others. An
    empty table gives no rows. Other columns are not looked at.
    """
    items = cut(pieces(docs, tokenizer, capacities.tokens, end_id, id_col, text_col, cache_parts))
    n_blocks = max(1, -(-items.count() // block_docs))

    def packed(first_pass: Capacities) -> DataFrame:
        first = cut(pack_pieces(items, n_blocks, first_pass, weights, score))
        if n_blocks == 1 and first_pass == capacities:
            return first.select(*out)
        low = F.col("filled") < refill * capacities.tokens
        again = first.filter(low).drop("sequence_id", "offset", "filled")
        second = pack_pieces(again, -(-n_blocks // merge), capacities, weights, score, base=1 << 31)
        return cut(first.filter(~low).select(*out).unionByName(second.select(*out)))

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    plain = packed(capacities)
    if wished is None:
        return plain
    better = packed(wished)
    n = [df.select("sequence_id").distinct().count() for df in (better, plain)]
    return better if n[0] <= n[1] else plain
