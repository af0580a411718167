"""Fill-in-the-middle examples, cut by big-integer bit-parallelism.

The bytes of a text are translated to the digits of a class mask, one binary number whose bit k tells of byte k. A
shift and a boolean operation turn masks into marks of the bytes where units begin, their bit count is the number of
units, and a ranked mark is found by halving: the lower half's bit count says which half holds it. All of it goes
through a text's bytes a few times, whatever the number of its units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle in an output.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
SPACES = b" \t\n\x0b\x0c\r"
UNITS = ("chars", "words", "lines")


def _digits(members: bytes) -> bytes:
    """A table for bytes.translate: the digit 1 for members, 0 for all other bytes."""
    return bytes(49 if b in members else 48 for b in range(256))


#: Bytes that begin a character, bytes of words, and ends of lines.
LEADS, WORDS, ENDS = _digits(bytes(b for b in range(256) if b & 0xC0 != 0x80)), _digits(bytes(b for b in range(256) if b not in SPACES)), _digits(b"\n")


def mask(data: bytes, table: bytes) -> int:
    """The number whose bit k is 1 where byte k belongs to the table's class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def marks(data: bytes, unit: str = "chars") -> int:
    """A bit at each byte that begins a unit: a code point, a word (with the white space behind it), or a line (with its end)."""
    if unit == "chars":
        return mask(data, LEADS)
    if unit == "words":
        inside = mask(data, WORDS)
        return inside & ~(inside << 1)
    every = (1 << len(data)) - 1
    return (mask(data, ENDS) << 1 | 1) & every


def select(bits: int, rank: int) -> int:
    """The place of the set bit with this rank, from 0; there must be more than `rank`."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def place(data: bytes, bits: int, n: int, rank: int) -> int:
    """The byte where the unit of this rank begins; what stands before the first unit goes with it, and rank n is the end."""
    return 0 if rank == 0 else len(data) if rank == n else select(bits, rank)


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """The first four 32-bit numbers of a seeded hash of an id."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearrange(data: bytes, doc_id: int | None, unit: str = "chars", rate: int = 90, spm: int = 20, seed: int = 1, markers: Sequence[bytes] = tuple(m.encode() for m in MARKERS)) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    bits = marks(data, unit)
    n = bits.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or any(m in data for m in markers):
        return n, PLAIN, None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = place(data, bits, n, first), place(data, bits, n, last)
    p, s, m = markers
    if h4 % 100 < spm:
        return n, SPM, first, last - first, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, PSM, first, last - first, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


#: Bytes of outputs that a task gathers before it passes them on.
BATCH_BYTES = 32 << 20


def fill_in_middle(docs: DataFrame, unit: str = "chars", rate: int = 90, spm: int = 20, seed: int = 1, markers: Sequence[str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, output.

    `rate` of a hundred texts are rearranged, `spm` of a hundred of these with their suffix first; which, and where they
    are cut, goes by a hash of seed and id alone, so that reruns and equal ids agree. Null and empty texts, and texts
    that hold a marker, stay as they are (null as empty). A null id hashes as an empty one and stays null; repeated rows
    give repeated rows; an empty table gives none. A text without any unit (white space, where units are words) may be
    rearranged, all of it in one part. A very long text takes about six times its bytes in one task. Other columns are
    not looked at.
    """
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    if len(set(markers)) != 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in markers):
        raise ValueError("three different markers in angle brackets, so that none can begin within another")
    coded = tuple(m.encode() for m in markers)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((doc, *rearrange(text.as_py() or b"", doc, unit, rate, spm, seed, coded)))
                size += len(rows[-1][-1])
                if size > BATCH_BYTES:
                    yield taken()
                    rows, size = [], 0
        if rows:
            yield taken()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of this form was made from. Parts hold no marker, and none can arise where parts meet one, so that the three in an output part it into nothing, and the parts in their order."""
    parts = F.array(F.split(output, "|".join(re.escape(m) for m in markers), -1))
    psm = F.transform(parts, lambda p: F.concat(p[1], p[3], p[2]))[0]
    spm = F.transform(parts, lambda p: F.concat(p[2], p[3], p[1]))[0]
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


#: The digest of `fill_in_middle` over documents in DuckDB's SQL. A text restored is the text.
INFILL_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""
