"""Minimax contiguous partition: groups of equal texts, in the order of their hash, are cut into shards of nearly equal bytes.

The smallest feasible capacity of a shard is found by binary search, each capacity checked greedily. The driver
knows the groups as ranges of the hash with their totals. Ranges taken as whole bound the capacity from above, ranges
that may be cut anywhere from below, and only ranges in which a cut may fall for a capacity between the bounds are
opened, the largest first, until every such range is a single group. A round fetches at most FETCH totals, whatever
the sizes of the groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, utf8

#: Totals of hash ranges that a round brings to the driver at most, and the bits by which it opens a range.
FETCH, OPENED_BITS = 1 << 14, 6


class Ranges:
    """Hash ranges in order. rows: (bits, spot, bytes, groups), a range being the hashes that begin with `bits` bits of value `spot`."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows, key=lambda r: r[1] << (64 - r[0]))
        self.ends = list(accumulate(r[2] for r in self.rows))
        self.total = self.ends[-1]

    def whole(self, capacity: int, shards: int) -> list[int]:
        """Where each shard ends, in bytes, if no range is cut; a range above the capacity stops all further ones."""
        at, out = 0, []
        for _ in range(shards):
            k = bisect.bisect_right(self.ends, at + capacity)
            at = max(at, self.ends[k - 1] if k else 0)
            out.append(at)
        return out

    def anywhere(self, capacity: int, shards: int) -> list[int]:
        """The furthest that each shard can end if ranges of several groups may be cut anywhere."""
        at, out = 0, []
        for _ in range(shards):
            at = min(at + capacity, self.total)
            k = bisect.bisect_left(self.ends, at)
            if self.rows[k][3] == 1 and self.ends[k] > at:
                at = self.ends[k] - self.rows[k][2]
            out.append(at)
        return out

    def smallest(self, ends: Callable[[int, int], list[int]], shards: int, low: int) -> int:
        """The smallest capacity from low on at which the last shard's end is the end of all."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if ends(mid, shards)[-1] == self.total else (mid + 1, high)
        return low

    def undecided(self, shards: int, largest: int) -> tuple[int, list[tuple[int, int, int, int]]]:
        """(a feasible capacity, ranges of several groups in which the cuts of the smallest one may fall). With no such range the capacity is the smallest."""
        low = self.smallest(self.anywhere, shards, max(largest, -(-self.total // shards)))
        high = self.smallest(self.whole, shards, low)
        found: set[int] = set()
        for a, b in zip(self.whole(low, shards - 1), self.anywhere(high, shards - 1), strict=True):
            found.update(range(bisect.bisect_right(self.ends, a), min(bisect.bisect_left(self.ends, b) + 1, len(self.ends))))
        return high, [self.rows[k] for k in found if self.rows[k][3] > 1]


def _totals(groups: DataFrame, chosen: list[tuple[int, int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """Totals of first ranges, or of the ranges that the chosen ones are opened into."""
    place = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    spot = lambda bits: F.shiftrightunsigned(place, 64 - bits)
    if chosen is None:
        bits = FETCH.bit_length() - 1
        rows = groups.select(F.lit(bits).alias("bits"), spot(bits).alias("spot"), "bytes")
    else:
        parts = []
        for bits in sorted({r[0] for r in chosen}):
            finer = min(64, bits + OPENED_BITS)
            value = F.when(spot(bits).isin([r[1] for r in chosen if r[0] == bits]), F.struct(F.lit(finer).alias("bits"), (spot(finer) if finer < 64 else place).alias("spot")))
            parts.append(value)
        rows = groups.select(F.coalesce(*parts).alias("at"), "bytes").filter("at is not null").select("at.bits", "at.spot", "bytes")
    found = rows.groupBy("bits", "spot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    return [(r["bits"], r["spot"] & (2**64 - 1), r["bytes"], r["n"]) for r in found]


def cuts_by_totals(totals: Callable[[list[tuple[int, int, int, int]] | None], list[tuple[int, int, int, int]]], shards: int, largest: int) -> list[int]:
    """The hashes that end shards 0 to shards - 2. totals: those of first ranges (None), or of what the given ranges are opened into."""
    ranges = Ranges(totals(None))
    while True:
        capacity, open_ = ranges.undecided(shards, largest)
        if not open_:
            break
        chosen = set(sorted(open_, key=lambda r: -r[2])[: FETCH >> OPENED_BITS])
        ranges = Ranges([r for r in ranges.rows if r not in chosen] + totals(list(chosen)))
    out = []
    for at in ranges.whole(capacity, shards)[:-1]:
        k = bisect.bisect_right(ranges.ends, at) - 1  # the last range of the shard
        out.append(((ranges.rows[k][1] + 1) << (64 - ranges.rows[k][0])) - 1 - 2**63 if k >= 0 else -(2**63))
    return out


def contiguous_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The hashes that end shards 0 to shards - 2. groups: h long (the order), bytes long, one row an h."""
    largest = groups.agg(F.max("bytes")).first()[0]
    return [] if largest is None else cuts_by_totals(lambda chosen: _totals(groups, chosen), shards, largest)


def shard_documents(docs: DataFrame, shards: int = 8, slot_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts stay together: a group is never split, so one group larger than its share is a shard by itself. Groups
    go by a 64-bit hash; different texts that meet in one are one group, which at most makes shards less equal by a text.
    A null text is a group of its own with the size and checksum of no bytes; null ids stay; repeated rows get slots
    of their own; an empty table gives no rows. Slots are gapless from 0 in each shard, counted in slices of about
    slot_rows rows. Of a text only its size and its sums are kept, whatever its length. Other columns are not looked at.
    """
    text = utf8(F.col(text_col))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
            F.xxhash64(F.col(text_col)).alias("h"),
        )
    )
    n = rows.count()
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    cuts = contiguous_cuts(groups, shards)
    shard = sum((F.when(F.col("h") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # rows come from the shared folder in a fixed order, so their places there are the same on every read
    slices = max(1, n // (shards * slot_rows))
    placed = rows.withColumn("shard", shard).withColumn("slice", numbered(F.monotonically_increasing_id(), slices))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("h", "doc_id")))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    before = counts.select("shard", "slice", (F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")).alias("before"))
    return ranked.join(before, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
