"""Token ids in a binary format: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed.

A segment holds whole documents and can be read alone:

    "SLP1" | kind u8 (0 byte planes, 1 bit planes) | 3 zero bytes | documents u32 | ids per block u32 | ids u64
    document index: per document, known u8 | doc_id i64 | ids u64
    block index: per block, ids u32 and the compressed length u32 of each plane
    the planes, each a zstandard frame

All numbers are little-endian. A dataset is a table of segments (shard, segment, ids_before, n_docs, n_ids, payload)
written by Spark, so that a lost task leaves no half-written file and the folder may lie in any store. Its columns
but the payload are the index over segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .tokens import encoder

HEAD = struct.Struct("<4sB3xIIQ")
DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u8")])
KINDS = {"bytes": 0, "bits": 1}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bytes":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bytes":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def write_segment(docs: list[tuple[int | None, bytes]], kind: str = "bytes", block: int = 16_384, level: int = 3) -> bytes:
    """docs: (doc_id, little-endian 32-bit ids)."""
    index = np.array([(d is not None, d or 0, len(x) // 4) for d, x in docs], DOC)
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    pack = zstandard.ZstdCompressor(level=level).compress
    lengths, frames = [], []
    for at in range(0, len(ids), block):
        part = [pack(p) for p in to_planes(ids[at : at + block], kind)]
        lengths += [min(block, len(ids) - at), *map(len, part)]
        frames += part
    return b"".join([HEAD.pack(b"SLP1", KINDS[kind], len(docs), block, len(ids)), index.tobytes(), np.array(lengths, "<u4").tobytes(), *frames])


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document index, ids)."""
    magic, code, n_docs, block, n_ids = HEAD.unpack_from(payload)
    if magic != b"SLP1":
        raise ValueError("not a segment of token planes")
    kind = next(k for k, v in KINDS.items() if v == code)
    width = 4 if kind == "bytes" else 32
    at = HEAD.size
    docs = np.frombuffer(payload, DOC, n_docs, at)
    at += docs.nbytes
    n_blocks = -(-n_ids // block)
    table = np.frombuffer(payload, "<u4", n_blocks * (1 + width), at).reshape(n_blocks, 1 + width)
    at += table.nbytes
    unpack = zstandard.ZstdDecompressor().decompress
    ids = []
    for n, *sizes in table.tolist():
        planes = []
        for size in sizes:
            planes.append(unpack(payload[at : at + size]))
            at += size
        ids.append(from_planes(planes, n, kind))
    return docs, np.concatenate(ids) if ids else np.empty(0, "<u4")


def document_index(payload: bytes) -> np.ndarray:
    """What a segment holds: known, doc_id and n of each document, without reading any block."""
    return np.frombuffer(payload, DOC, HEAD.unpack_from(payload)[2], HEAD.size)


def read_document(payload: bytes, number: int) -> np.ndarray:
    """The ids of one document of a segment, by its place in the document index. Only the blocks that hold them are decompressed: the block index says where these lie."""
    magic, code, n_docs, block, n_ids = HEAD.unpack_from(payload)
    if magic != b"SLP1":
        raise ValueError("not a segment of token planes")
    if not 0 <= number < n_docs:
        raise IndexError(f"document {number} of {n_docs}")
    kind = next(k for k, v in KINDS.items() if v == code)
    width = 4 if kind == "bytes" else 32
    docs = np.frombuffer(payload, DOC, n_docs, HEAD.size)
    start = int(docs["n"][:number].sum())
    stop = start + int(docs["n"][number])
    if start == stop:
        return np.empty(0, "<u4")
    n_blocks = -(-n_ids // block)
    table = np.frombuffer(payload, "<u4", n_blocks * (1 + width), HEAD.size + docs.nbytes).reshape(n_blocks, 1 + width)
    sizes = table[:, 1:].astype(np.int64)
    first, last = start // block, (stop - 1) // block
    at = HEAD.size + docs.nbytes + table.nbytes + int(sizes[:first].sum())
    unpack = zstandard.ZstdDecompressor().decompress
    ids = []
    for k in range(first, last + 1):
        planes = []
        for size in sizes[k].tolist():
            planes.append(unpack(payload[at : at + size]))
            at += size
        ids.append(from_planes(planes, int(table[k, 0]), kind))
    return np.concatenate(ids)[start - first * block : stop - first * block]


def find_documents(segments: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(doc_id, ids array<long>) of the documents with these ids, as often as they occur. Of a segment only the blocks of such documents are decompressed.

    Documents whose id is null are never found, ids that no document has give no row, no ids and an empty table give
    none at all. A document's ids are one array, however long. Other columns are not looked at.
    """
    wanted = np.array(sorted(set(ids)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scalar in batch.column(0):
                payload = scalar.as_py()
                docs = document_index(payload)
                for k in np.flatnonzero((docs["known"] == 1) & np.isin(docs["doc_id"], wanted)).tolist():
                    found = read_document(payload, k).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(docs["doc_id"][k])], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return segments.select("payload").mapInArrow(run, "doc_id long, ids array<long>")


SEGMENT = "shard int, segment int, ids_before long, n_docs long, n_ids long, payload binary"


def encode_segments(docs: DataFrame, tokenizer: str, end_id: int | None = 2, kind: str = "bytes", block: int = 16_384, segment_ids: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments in ascending document order: shards are ranges of doc_id (null first, equal ids by their texts' checksum), and a task streams through one shard. A segment ends with the document that fills it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        shard, number, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def segment() -> pa.RecordBatch:
            row = (shard, number, before, len(held), size, write_segment(held, kind, block))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "segment", "ids_before", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                held.append((doc, ids))
                size += len(ids) // 4
                if size >= segment_ids:
                    yield segment()
                    number, before, held, size = number + 1, before + size, [], 0
        if held:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    # equal rows are told apart by their places, so that very many of them are several ranges
    ordered = rows.withColumn("tie", tie).withColumn("place", F.monotonically_increasing_id()).repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(run, SEGMENT)


def write_dataset(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    segments = encode_segments(docs, tokenizer, **options)
    segments.write.option("parquet.block.size", 16 << 20).option("compression", "none").mode("overwrite").parquet(path)


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the segments alone: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, before, payload = batch.columns
            for s, b, p in zip(shard.to_pylist(), before.to_pylist(), payload, strict=True):
                docs, ids = read_segment(p.as_py())
                stops = np.cumsum(docs["n"].astype(np.int64))
                octets = memoryview(np.ascontiguousarray(ids).view(np.uint8))
                starts = stops - docs["n"].astype(np.int64)
                sums = [zlib.crc32(octets[4 * i : 4 * j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs["doc_id"], pa.int64(), mask=docs["known"] == 0), pa.array([s] * len(docs), pa.int32()), pa.array(starts + b), pa.array(docs["n"].astype(np.int64)), pa.array(sums, pa.int64())],
                    ["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
                )

    from pyspark.sql import Window

    # one row a shard, as many as the shuffle has partitions
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = segments.select("shard", "ids_before", "payload").mapInArrow(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Writes docs to a dataset of token planes and reads every document back from it.

    Null and empty texts hold the end id alone; null ids come first and stay null; repeated rows stay rows of
    their own. An empty table gives no rows. A very long text is a segment by itself, held whole by one task. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-planes")
    write_dataset(docs, path, tokenizer, **options)
    return read_documents(spark.read.schema(SEGMENT).parquet(path))
