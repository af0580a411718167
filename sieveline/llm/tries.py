"""The prefix trie of conversations, built as a Patricia trie over ranges of sorted sequences.

A conversation is a sequence of digests of its turns. Sequences are made distinct, sorted, and dealt out in ranges. A
task goes through its range once and creates points only where a sequence ends or two neighbours part; what lies
between two points is an edge. Members, leaves, children and saved bytes are added up along the points, and the nodes
within an edge come last, from suffix sums over the edge's turns: they have their lower point's members.

A node that neighbouring ranges share (a prefix of the sequences where they meet, and those alone) is written by each
with its own share, and the shares are added; what must count once goes with the range that the node begins in.
Of a turn that no other conversation has at its depth nothing below is shared: such tails are chains of one member,
written from the turns themselves, so that sequences are gathered only as far as they may be shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, utf8

#: Hexadecimal digits of a turn's digest.
KEY = 32
#: Turns taken from another conversation are fewer than this, and conversations whose number it is a multiple of lend theirs.
MOST, LENDER = 9, 5
#: Ids of a group that are joined before they meet the others, and rows that a task gathers before it passes them on.
CHUNK, BATCH = 8192, 16_384


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over, from a checksum of its number."""
    return F.crc32(utf8(conv_id.cast("string"))) % MOST


def in_turn(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, key, bytes) with `pos`, their place in their conversation, from 0; nulls first, ties by key.

    By a range sort of all rows, so that a conversation of any share of the rows spreads over tasks. A range tells the
    driver two conversations and two counts.
    """
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    rows = turns.withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "key", "bytes", F.spark_partition_id().alias("part")))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        n_first = n_last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, part = batch.column(0).to_numpy(), batch.column(1)[0].as_py()
            if first is None:
                first = last = ids[0]
            if last == first:
                n_first += int((ids == first).sum())
            n_last = n_last * int(ids[-1] == last) + int((ids == ids[-1]).sum())
            last = ids[-1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, first, n_first, last, n_last)], ["part", "first", "n_first", "last", "n_last"])

    begun: dict[int, int] = {}  # by part: turns of its first conversation in the parts before it
    at = n = None
    for r in sorted(rows.select("conv_id", "part").mapInArrow(edges, "part long, first long, n_first long, last long, n_last long").collect()):
        begun[r["part"]] = n if r["first"] == at else 0
        n = r["n_last"] + (begun[r["part"]] if r["last"] == r["first"] else 0)
        at = r["last"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            if last is None:
                last, n = ids[0], begun[batch.column(3)[0].as_py()]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            pos = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            if ids[0] == last:
                pos[: starts[1] if len(starts) > 1 else len(ids)] += n
            last, n = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pos)], ["conv_id", "key", "bytes", "pos"])

    return rows.mapInArrow(place, "conv_id long, key string, bytes long, pos long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, total; their turns: conv_id, d from 1, key, bytes, total) with the first turns of each taken from its lender."""
    own = cut(in_turn(turns))
    lent = own.filter((F.col("pos") < MOST - 1) & (F.col("conv_id") % LENDER == 0))
    lent = lent.groupBy(F.col("conv_id").alias("lender")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns"))
    ids = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", shared_turns(F.col("conv_id")))
    ids = ids.withColumn("lender", F.col("conv_id") - F.col("conv_id") % LENDER).join(lent, "lender", "left")
    taken = F.coalesce(F.slice("turns", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,key:string,bytes:bigint>>"))
    ids = ids.withColumn("taken", taken).withColumn("total", (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
    ids = cut(ids.select("conv_id", "h", "taken", "total"))
    first = ids.select("conv_id", "total", F.explode("taken").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("d"), "t.key", "t.bytes", "total")
    rest = own.filter(F.col("pos") >= shared_turns(F.col("conv_id"))).join(ids.select("conv_id", "h", F.size("taken").alias("m"), "total"), "conv_id")
    rest = rest.select("conv_id", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("d"), "key", "bytes", "total")
    return ids.select("conv_id", "total"), cut(first.unionByName(rest))


def common_turns(a: str, b: str) -> int:
    at, n = 0, min(len(a), len(b))
    while at < n and a[at : at + KEY] == b[at : at + KEY]:
        at += KEY
    return at // KEY


FIELDS = (
    ("part", "int"),
    ("depth", "long"),
    ("node", "string"),  # where others must find it: shared nodes, and ends of several conversations
    ("parent", "string"),  # of a child of a shared node
    ("conv_id", "long"),
    ("parent_conv_id", "long"),
    ("n_convs", "long"),
    ("n_children", "long"),
    ("n_leaves", "long"),
    ("saved_tokens", "long"),
    ("n_ends", "long"),
    ("end_id", "long"),
    ("shared", "boolean"),
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


class Point:
    """A node where sequences end or part, with what its subtree holds in this range. `below` leaves out its own turn; `waiting` are nodes right below it, which need its conversation."""

    __slots__ = ("below", "children", "conv_id", "depth", "end_id", "ends", "leaves", "n", "waiting")

    def __init__(self, depth: int, conv_id: int | None = None, n: int = 0, leaves: int = 0, below: int = 0, children: int = 0):
        self.depth, self.conv_id, self.n, self.leaves, self.below, self.children = depth, conv_id, n, leaves, below, children
        self.ends, self.end_id, self.waiting = 0, None, []

    def end(self, conv_id: int, n: int, tail: bool) -> None:
        """n conversations end here, or one goes on alone (tail)."""
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        if tail:
            self.children, self.leaves = 1, 1
        else:
            self.ends, self.end_id = n, conv_id


class Range:
    """One range of sorted distinct sequences. before, after: turns that its first sequence shares with the one before the range, and its last with the one after; -1 where there is none. `out` gets the rows of FIELDS."""

    def __init__(self, part: int, before: int, after: int):
        self.part, self.before, self.after = part, before, after
        self.path, self.sizes, self.stack, self.out = "", [], [], []
        self.first = 0  # so many turns of the path are those of the first sequence

    def put(self, seq: str, sizes: list[int], n: int, conv_id: int, tail: bool) -> None:
        depth = len(seq) // KEY
        if not self.stack:
            self.stack, self.first = [Point(0)], depth
        else:
            same = common_turns(self.path, seq)
            self.close(same)
            self.first = min(self.first, same)
        self.path, self.sizes = seq, sizes
        if depth > self.stack[-1].depth:
            self.stack.append(Point(depth))
        self.stack[-1].end(conv_id, n, tail)

    def done(self) -> None:
        """Closes all that is left, the root too."""
        if self.stack:
            self.close(0, last=True)
            root = self.stack.pop()
            if not (root.children or root.leaves or self.after >= 0):
                root.leaves = 1
            row = self.node(root, 0, root.below, root.children, last=True)
            self.settle(root, row[-1], self.key(0))
            self.out.append(row)

    def known(self, d: int) -> bool:
        """Whether the node at depth d of the path begins in an earlier range."""
        return d <= self.first and d <= self.before

    def shared(self, d: int, last: bool) -> bool:
        # the root is every range's
        return self.known(d) or (last and d <= self.after) or (d == 0 and self.after >= 0)

    def key(self, d: int) -> str:
        return hashlib.md5(self.path[: KEY * d].encode(), usedforsecurity=False).hexdigest()

    def node(self, q: Point, d: int, saved: int, children: int, last: bool) -> tuple:
        shared, ends = self.shared(d, last), q.ends if d == q.depth else 0
        name = self.key(d) if shared or ends > 1 else None
        return self.part, d, name, None, q.conv_id, None, q.n, children, q.leaves, saved, ends, q.end_id if ends else None, shared

    def settle(self, p: Point, shared: bool, name: str) -> None:
        """Gives the nodes that wait right below a point its conversation, or, where other ranges share it, its name."""
        for row in p.waiting:
            self.out.append((*row[:3], name if shared else None, row[4], None if shared else p.conv_id, *row[6:]))
        p.waiting = []

    def close(self, depth: int, last: bool = False) -> None:
        """Closes the points below this depth of the path, and makes one there if there is none."""
        while self.stack[-1].depth > depth:
            q = self.stack.pop()
            if not (q.children or q.leaves) and not (last and q.depth <= self.after):
                q.leaves = 1
            above = max(depth, self.stack[-1].depth)
            if self.stack[-1].depth < above:
                self.stack.append(Point(above))
            p = self.stack[-1]
            saved, children, under = q.below, q.children, None
            for d in range(q.depth, above, -1):
                saved += (q.n - (not self.known(d))) * self.sizes[d - 1]
                row = self.node(q, d, saved, children, last)
                if d == q.depth:
                    self.settle(q, row[-1], row[2] or "")
                if under is not None:  # the node below within the edge: its parent is this one
                    self.out.append((*under[:3], row[2] if row[-1] else None, under[4], None if row[-1] else q.conv_id, *under[6:]))
                children, under = int(not self.known(d)), row
            p.waiting.append(under)
            if self.known(above) or (above == 0 and self.shared(0, last)):  # it is sure to be shared: nothing need wait
                self.settle(p, True, self.key(above))
            p.n += q.n
            p.conv_id = q.conv_id if p.conv_id is None else min(p.conv_id, q.conv_id)
            p.leaves, p.below, p.children = p.leaves + q.leaves, p.below + saved, p.children + children


def _grow(bounds: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = None

        def taken(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, (_, t) in enumerate(FIELDS)], [name for name, _ in FIELDS])

        for batch in batches:
            part, seq, sizes, n, conv, tail = batch.columns
            if grown is None and batch.num_rows:
                grown = Range(part[0].as_py(), *bounds[part[0].as_py()])
            for row in zip(seq, sizes, n.to_pylist(), conv.to_pylist(), tail.to_pylist(), strict=True):
                grown.put(row[0].as_py(), row[1].as_py(), *row[2:])
                if len(grown.out) >= BATCH:
                    yield taken(grown.out)
                    grown.out = []
        if grown is not None:
            grown.done()
            yield taken(grown.out)

    return run


def range_bounds(groups: DataFrame) -> dict[int, tuple[int, int]]:
    """By part: the turns that its first and its last sequence share with the neighbouring parts. One row a part throughout, the windows too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["part"], *(-1 if a is None or b is None else common_turns(a, b) for a, b in ((r["prior"], r["lo"]), (r["hi"], r["next"])))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["part", "before", "after"])

    order = Window.orderBy("part")
    ends = groups.groupBy("part").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    ends = ends.withColumn("prior", F.lag("hi").over(order)).withColumn("next", F.lead("lo").over(order))
    return {r["part"]: (r["before"], r["after"]) for r in ends.mapInArrow(run, "part long, before long, after long").collect()}


def joined_ids(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where two conversations or more end. members: (node, conv_id).

    A digest is worked out in sequence. Ids are sorted by ranges of (node, id), joined to texts of some thousand ids
    where they lie, and only these texts, in their order, meet in the task that has the node; it holds one at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int, str]] = []
        name, ids, opened = None, [], True

        def close(edge: bool) -> None:
            # a node of one id within the range ends one conversation alone; at the range's edges the rest may lie next door
            if ids and (edge or opened or len(ids) > 1):
                held.append((name, ids[0], len(ids), ",".join(map(str, ids))))

        def taken() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], ["node", "first", "n", "ids"])

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != name:
                    close(False)
                    opened = name is None  # the range's first node
                    name, ids = node, []
                elif len(ids) == CHUNK:
                    close(True)
                    opened, ids = True, []
                ids.append(conv)
            if len(held) >= 256:
                yield taken()
                held = []
        close(True)
        if held:
            yield taken()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, digest = None, 0, hashlib.sha256()
        out: list[tuple[str, str]] = []
        for batch in batches:
            for node, n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if node != name:
                    if total > 1:
                        out.append((name, digest.hexdigest()))
                    name, total, digest = node, 0, hashlib.sha256()
                digest.update((b"," if total else b"") + ids.as_py().encode())
                total += n
        if total > 1:
            out.append((name, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], ["node", "ends_sha256"])

    texts = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node string, first long, n long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, ends_sha256 string")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations are rebuilt as `rebuilt` says, by the order of their turns, null first, ties by a digest of role and
    text; a null role or text is an empty one. Turns of equal place, role and text are turns of their own. Turns
    without a conv_id belong to no conversation and have no node. An empty table has no node, not even a root. Texts
    stay where they are read, only 128-bit digests of turns move; different turns of equal digests would be one. A task
    holds the sequences of two conversations, as far as another conversation has the same turn at the same depth, and
    the children of the branches within its range. Other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    ids, rows = rebuilt(turns)

    # the first turn that no other conversation has at its depth ends what may be shared
    alone = rows.groupBy("d", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1").groupBy("conv_id").agg(F.min("d").alias("stop"))
    rows = rows.join(alone, "conv_id", "left")
    head = rows.filter(F.col("stop").isNull() | (F.col("d") <= F.col("stop"))).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "key", "bytes"))).alias("t"))
    seqs = ids.join(head, "conv_id", "left").select("conv_id", F.coalesce(F.array_join("t.key", ""), F.lit("")).alias("seq"), F.coalesce("t.bytes", F.array().cast("array<bigint>")).alias("sizes"), (F.col("total") > F.coalesce(F.size("t.d"), F.lit(0))).alias("tail"))
    seqs = cut(seqs)

    groups = seqs.groupBy("seq").agg(F.min("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("tail").alias("tail"))
    groups = cut(groups.repartitionByRange("seq").sortWithinPartitions("seq").select(F.spark_partition_id().alias("part"), "seq", "sizes", "n", "conv_id", "tail"))
    nodes = cut(groups.mapInArrow(_grow(range_bounds(groups)), ", ".join(f"{n} {t}" for n, t in FIELDS)))

    several = nodes.filter("shared")
    add = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")]
    whole = cut(several.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("end_id").alias("end_id"), *add))
    named = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = ("node", *COLUMNS, "n_ends", "end_id")
    inner = nodes.filter(~F.col("shared"))
    # a range's shared nodes go to the range's rows, so that the children of one node are joined range by range
    local = several.select("part", "node").join(whole.select("node", F.col("conv_id").alias("parent_conv_id")), "node").withColumnRenamed("node", "parent")
    found = inner.filter(F.col("parent").isNull()).select(*out)
    found = found.unionByName(inner.filter(F.col("parent").isNotNull()).drop("parent_conv_id").join(local, ["part", "parent"]).select(*out))
    found = found.unionByName(whole.join(named, "parent", "left").select(*out))

    sha = lambda c: F.sha2(utf8(c), 256)
    one = F.when(F.col("n_ends") == 1, F.col("end_id").cast("string")).otherwise("")
    single = found.filter(F.col("n_ends") <= 1).select(*COLUMNS, sha(one).alias("ends_sha256"))
    copies = found.filter(F.col("n_ends") > 1).join(joined_ids(seqs.select(F.md5(utf8(F.col("seq"))).alias("node"), "conv_id")), "node").select(*COLUMNS, "ends_sha256")
    last = F.col("d") == F.col("total")
    tails = rows.filter(F.col("d") > F.col("stop")).select(
        "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), sha(F.when(last, F.col("conv_id").cast("string")).otherwise("")).alias("ends_sha256"),
    )
    return single.unionByName(copies).unionByName(tails)


#: `prefix_trie` over conversations in DuckDB's SQL: every prefix of every conversation, without points or edges.
TRIE_SQL = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM (SELECT conv_id AS c, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL)),
i AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda j: ascii(substr(CAST(c AS VARCHAR), j, 1))::BIGINT)), lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
g AS (SELECT i.c, t.pos + 1 AS d, t.k, t.b FROM i JOIN t ON t.c = i.c - i.c % 5 AND t.pos < i.h),
m AS (SELECT i.c, i.h, (SELECT count(*) FROM g WHERE g.c = i.c) AS m FROM i),
r AS (SELECT * FROM g UNION ALL SELECT t.c, m.m + t.pos - m.h + 1, t.k, t.b FROM t JOIN m ON t.c = m.c AND t.pos >= m.h),
p AS (SELECT c, d, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node, b FROM r UNION ALL SELECT c, 0, 'root', 0 FROM i),
q AS (SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS stops FROM p WINDOW w AS (PARTITION BY c ORDER BY d)),
n AS (SELECT d, node, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b, coalesce(string_agg(CASE WHEN stops THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM q GROUP BY d, node),
k AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY d, up),
s AS (SELECT p.d, p.node, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.b) AS saved FROM n LEFT JOIN k ON n.d = k.d AND n.node = k.node JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.d, p.node)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.node = n.up LEFT JOIN k ON n.d = k.d AND n.node = k.node JOIN s ON n.d = s.d AND n.node = s.node"""
