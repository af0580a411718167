"""Near duplicates by SimHash: exact comparison in tiles by exclusive-or and bit counts, then connected components.

Equal fingerprints are one node. Nodes lie in cells by what their fingerprints' population counts are, part by part
of the fingerprint, and optionally by a size class of their documents; two cells are compared only if the counts
differ by no more than the radius, as every differing bit changes one part's count by one. Cells are cut into tiles of
at most `tile` nodes, so a unit of work, a pair of tiles, is bounded whatever the size of a group of near copies. A
unit yields a spanning forest of its links, never all of them: the components are the same, and the rows grow with
the nodes, not with the pairs.

Where a similarity is asked for, the distance only proposes: a node is then a set of shingles, the components of the
proposed links are groups, and a second pass over each group's tiles, which now carry the sets, links the pairs whose
sets are that similar. Every proposed pair lies within one group, so none is lost to the forests of the first pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, new_path

SEED = 42
#: Nodes of one tile: a unit compares at most the square of this.
TILE = 2048
#: The same where shingle sets are carried, and how many shingles one such tile has, about.
SET_TILE, SET_SHINGLES = 512, 1 << 17
#: Rounds after which components give up: far more than the logarithm of any path needs.
ROUNDS = 60


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of `words` words, A-Z lower-cased, joined by spaces, with repeats; all words if they are fewer."""
    own = (text or "").encode().lower().split()
    n = len(own)
    if n <= words:
        return [b" ".join(own)] if own else []
    join = b" ".join
    return list(map(join, zip(*(own[k:] for k in range(words)), strict=False)))


def hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text, words)], dtype=np.uint64)


def _widen(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word of a shingle's hash; the 0th is the hash."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; none for no hash. Blocks bound the memory of long texts."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, n_words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text", by_set: bool = False) -> DataFrame:
    """doc_id, text_hash, node, fp, n: fp has n_words 64-bit words, little-endian, as bytes; n is the number of shingles.
    distinct: each shingle counts once. node names fp: the word itself, or a 64-bit hash of several; by_set: node is a
    hash of the shingles themselves, in order, so that with distinct equal nodes are equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes = [], [], []
            for text in batch.column(2):
                h = hashes(text.as_py(), words)
                if distinct:
                    h = np.unique(h)
                fp = b"".join(majority(_widen(h, k)).to_bytes(8, "little") for k in range(n_words))
                if by_set:
                    name = xxhash.xxh64_intdigest(np.sort(h).astype("<u8").tobytes(), SEED).to_bytes(8, "little")
                else:
                    name = fp if n_words == 1 else xxhash.xxh64_intdigest(fp, SEED).to_bytes(8, "little")
                nodes.append(int.from_bytes(name, "little", signed=True))
                fps.append(fp)
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "text_hash", "node", "fp", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, fp binary, n long")


def neighbours(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts of absolute sum at most radius."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        out = [(*d, x) for d in out for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return out


def _forest(a: np.ndarray, b: np.ndarray | None, ids_a: np.ndarray, ids_b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest between nodes at most radius apart: within a, or between a and b. a, b: (nodes, words)."""
    same = b is None
    if same:
        b, ids_b = a, ids_a
    left = list(range(len(a)))
    right = left if same else list(range(len(a), len(a) + len(b)))
    parent = list(range(len(a) + (0 if same else len(b))))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    step = max(1, (1 << 17) // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        distance = np.bitwise_count(rows[:, None, 0] ^ b[None, :, 0])
        if a.shape[1] > 1:
            distance = distance.astype(np.uint16)
            for k in range(1, a.shape[1]):
                distance += np.bitwise_count(rows[:, None, k] ^ b[None, :, k])
        i, j = np.nonzero(distance <= radius)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(left[x]), root(right[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((int(ids_a[x]), int(ids_b[y])))
    return links


def links(nodes: DataFrame, radius: int, parts: int, n_words: int = 1, size_ratio: float | None = None, first_radius: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, unit by unit, of the links between nodes (node long, fp binary, n long).

    parts: parts of the fingerprint whose counts make a cell (0: the cell is the size class alone). size_ratio: nodes
    whose n differ by more than this factor need not be compared.
    """
    # a cell is a number: a field for each part's count, wide enough that no step to a neighbour leaves it, and the size class above them
    width = (64 * n_words // max(parts, 1) + 2 * radius).bit_length()
    if parts * width > 54:
        raise ValueError("so many parts and so large a radius have no room in a cell's number")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            octets = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            cell = np.zeros(batch.num_rows, np.int64)
            if parts:
                counts = np.bitwise_count(octets).reshape(batch.num_rows, parts, -1).sum(axis=2).astype(np.int64) + radius
                cell = counts @ (1 << (width * np.arange(parts, dtype=np.int64)))
            if size_ratio:
                band = np.floor(np.log(np.maximum(batch.column(2).to_numpy(), 1)) / -math.log(size_ratio) + 1e-9).astype(np.int64)
                cell += (band + 1) << (parts * width)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "node", "fp"])

    placed = nodes.select("node", "fp", "n").mapInArrow(cells, "cell long, node long, fp binary")
    # a cell's nodes are dealt to enough tiles beforehand; a tile is the unit that is gathered
    counted = cut(placed)
    room = counted.groupBy("cell").agg(F.count("*").alias("nodes")).select(F.col("cell").alias("c"), F.ceil(F.col("nodes") / (tile / 2)).cast("int").alias("tiles"))
    dealt = counted.join(room, F.col("cell") == F.col("c")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = dealt.groupBy("cell", "tile", "tiles").agg(F.collect_list(F.struct("node", "fp")).alias("members"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for members in batch.column(3).to_pylist():
                rows.append((np.array([m["node"] for m in members], "<i8").tobytes(), b"".join(m["fp"] for m in members)))
            yield pa.RecordBatch.from_arrays([*list(batch.columns)[:3], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["cell", "tile", "tiles", "ids", "fps"])

    tiles = cut(packed.mapInArrow(gather, "cell long, tile int, tiles int, ids binary, fps binary"))
    bands = (-1, 0, 1) if size_ratio else (0,)
    # one of each pair of opposite steps, and none
    steps = sorted({x for d in neighbours(parts, radius) for s in bands if (x := sum(c << (width * p) for p, c in enumerate(d)) + (s << (parts * width))) >= 0})

    # keys first: which cell meets which, then, from each tile's own row, which tile meets which; tiles then meet by
    # cell and number, so that a cell with very many nodes is as many keys as it has tiles
    present = tiles.select("cell", "tiles").distinct()
    met = present.select(F.col("cell").alias("own"), F.explode(F.array(*[F.lit(x).cast("long") for x in steps])).alias("step")).withColumn("want", F.col("own") + F.col("step"))
    met = met.join(present, F.col("want") == F.col("cell")).select("own", "want", "tiles")
    keys = tiles.select(F.col("cell").alias("own"), F.col("tile").alias("number")).join(met, "own").select("own", "number", "want", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    keys = keys.filter((F.col("own") != F.col("want")) | (F.col("number") <= F.col("tile")))
    mine = tiles.select(F.col("cell").alias("own"), F.col("tile").alias("number"), F.col("ids").alias("own_ids"), F.col("fps").alias("own_fps"))
    theirs = tiles.select(F.col("cell").alias("want"), "tile", "ids", "fps")
    # no exchange by hand: adaptive execution may split a tile that very many others meet
    units = keys.join(mine, ["own", "number"]).join(theirs, ["want", "tile"])
    units = units.select((F.col("own") == F.col("want")).alias("same_cell"), "number", "own_ids", "own_fps", "tile", "ids", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same_cell, number, own_ids, own_fps, other, ids, fps in zip(*(c for c in batch.columns), strict=True):
                same = same_cell.as_py() and number.as_py() == other.as_py()
                a = np.frombuffer(own_fps.as_py(), "<u8").reshape(-1, n_words)
                b = None if same else np.frombuffer(fps.as_py(), "<u8").reshape(-1, n_words)
                if found := _forest(a, b, np.frombuffer(own_ids.as_py(), "<i8"), None if same else np.frombuffer(ids.as_py(), "<i8"), radius):
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return units.mapInArrow(compare, "a long, b long")


def _similar_forest(ids: np.ndarray, fps: np.ndarray, sizes: np.ndarray, sets: np.ndarray, split: int, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest between nodes at most radius apart whose sets of shingles have at least this Jaccard
    similarity: within all nodes (split 0), or between the first split ones and the others. sets: all sets, one after the other."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    dense = np.unique(sets, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [dense[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(len(sets), bool)
    links = []
    for x in range(split or len(ids)):
        at = split or x + 1
        near = np.bitwise_count(fps[at:] ^ fps[x]).sum(axis=1, dtype=np.uint16) <= radius
        near &= np.minimum(sizes[at:], sizes[x]) >= np.maximum(similarity * np.maximum(sizes[at:], sizes[x]) - 1e-6, 1)
        # what is linked already need not be compared
        others = [y for y in (np.nonzero(near)[0] + at).tolist() if root(y) != root(x)]
        if not others:
            continue
        mark[own[x]] = True
        starts = np.cumsum([0, *(len(own[y]) for y in others[:-1])])
        common = np.add.reduceat(mark[np.concatenate([own[y] for y in others])], starts, dtype=np.int64)
        mark[own[x]] = False
        for y, c in zip(others, common.tolist(), strict=True):
            if c >= similarity * (len(own[x]) + len(own[y]) - c) - 1e-6 and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                links.append((int(ids[x]), int(ids[y])))
    return links


def similar_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, n_words: int, radius: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", tile: int = SET_TILE, shingles_a_tile: int = SET_SHINGLES) -> DataFrame:
    """(a, b): a spanning forest, unit by unit, of the links of the given similarity within groups (node, root).

    nodes: (node, fp, n, stays), where stays names a document of docs that has the node's set. Sets are made anew from
    the texts of grouped nodes alone; a unit is a tile of a group, or two of them.
    """
    member = nodes.join(groups.select(F.col("node").alias("linked"), "root"), F.col("node") == F.col("linked")).select("root", "node", "fp", "n", F.col("stays.doc_id").alias("d"), F.col("stays.text_hash").alias("h"))
    # r is an expression of the root, so that a group with very many nodes can be split
    room = member.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / shingles_a_tile)).cast("int").alias("tiles")).select(F.col("root").bitwiseXOR(F.lit(0)).alias("r"), F.greatest("tiles", F.lit(1)).alias("tiles"))
    dealt = member.join(room, F.col("root") == F.col("r")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("r", "n")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = texts.join(dealt, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("root", "tile", "tiles", "node", "fp", "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes(t.as_py(), words)).astype("<u8").tobytes() for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*list(batch.columns)[:5], pa.array(own, pa.binary())], ["root", "tile", "tiles", "node", "fp", "shingles"])

    # repeated rows of the document that stays are one node
    once = found.mapInArrow(take, "root long, tile int, tiles int, node long, fp binary, shingles binary").groupBy("root", "tile", "tiles", "node").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    packed = once.groupBy("root", "tile", "tiles").agg(F.collect_list(F.struct("node", "fp", "shingles")).alias("members"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for members in batch.column(3):
                members = members.as_py()
                rows.append((np.array([m["node"] for m in members], "<i8").tobytes(), b"".join(m["fp"] for m in members), np.array([len(m["shingles"]) // 8 for m in members], "<i8").tobytes(), b"".join(m["shingles"] for m in members)))
            yield pa.RecordBatch.from_arrays([*list(batch.columns)[:3], *(pa.array([r[k] for r in rows], pa.binary()) for k in range(4))], ["root", "tile", "tiles", "ids", "fps", "sizes", "sets"])

    tiles = cut(packed.mapInArrow(gather, "root long, tile int, tiles int, ids binary, fps binary, sizes binary, sets binary"))
    parts = ("ids", "fps", "sizes", "sets")
    keys = tiles.filter(F.col("tile") < F.col("tiles") - 1).select("root", "tile", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("other"))
    several = tiles.filter("tiles > 1")
    theirs = several.select("root", F.col("tile").alias("other"), *(F.col(c).alias(f"other_{c}") for c in parts))
    across = keys.join(several.select("root", "tile", *parts), ["root", "tile"]).join(theirs, ["root", "other"])
    columns = [*parts, *(f"other_{c}" for c in parts)]
    units = tiles.select(*parts, *(F.lit(None).cast("binary").alias(f"other_{c}") for c in parts)).unionByName(across.select(*columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in zip(*batch.columns, strict=True):
                mine, others = [x.as_py() for x in unit[:4]], [x.as_py() or b"" for x in unit[4:]]
                ids, fps, sizes, sets = (np.frombuffer(x + y, kind) for x, y, kind in zip(mine, others, ("<i8", "<u8", "<i8", "<u8"), strict=True))
                split = len(mine[0]) // 8 if others[0] else 0
                if found := _similar_forest(ids, fps.reshape(-1, n_words), sizes, sets, split, radius, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return units.mapInArrow(compare, "a long, b long")


def _written(df: DataFrame, kind: str) -> DataFrame:
    """df by way of files in the shared folder. A checkpoint would hand on its plan's size, a product over all joins, which the rounds of components raise to the fourth power each: a second run of them on top drowns the driver in digits."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lowest(edges: DataFrame) -> DataFrame:
    """(k, m): the smallest v of each u. k is an expression of u, so that a join on it gets an exchange of its own, which adaptive execution can split where a u has very many rows."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("k"), "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node with a link. edges: (a, b).

    Large and small stars by turns: each node's larger neighbours, then its smaller ones, are linked to the smallest of
    all. Links stay as many as before or fewer, and the rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    for _ in range(ROUNDS):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("k", F.least("k", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large)
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = cut(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, words: int = 3, n_words: int = 1, radius: int = 2, parts: int = 8, distinct: bool = False, size_ratio: float | None = None, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, node, fp, n, root, component_id (the smallest doc_id reachable over fingerprints at most radius bits apart), is_first (its row is the one that stays).

    similarity: only pairs whose sets of shingles have at least this Jaccard similarity are links; the radius then
    says which pairs are looked at, and distinct must be set. A text without shingles is like its equals alone.

    A null text is an empty one: both have fingerprint zero, which links like any other. Null ids come first where
    they are compared by is_first, and don't count for component_id unless a component has no other. Of repeated
    rows each gets a row, and is_first marks all that equal the one that stays. An empty table gives no rows. A very
    long text is shingled whole in one task, some 100 bytes a word. Other columns are not looked at.
    """
    rows = cut(fingerprints(docs, words, n_words, distinct, id_col, text_col, by_set=similarity is not None))
    nodes = cut(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("n").alias("n"), F.min("doc_id").alias("smallest"), F.min(F.struct("doc_id", "text_hash")).alias("stays")))
    edges = cut(links(nodes, radius, parts, n_words, size_ratio, tile=tile))
    if similarity is not None:
        groups = _written(components(edges), "groups")
        edges = _written(similar_links(docs, nodes, groups, words, n_words, radius, similarity, id_col, text_col, min(tile, SET_TILE)), "links")
    roots = components(edges)
    rooted = nodes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", F.coalesce("root", "node").alias("root"), "smallest", "stays")
    # r is an expression of the root, as k above: a component with very many fingerprints can be split
    whole = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.min("stays").alias("stays")).select(F.col("root").bitwiseXOR(F.lit(0)).alias("r"), "component_id", "stays")
    named = rooted.select("node", "root").join(whole, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "root", "component_id", "stays")
    first = F.struct("doc_id", "text_hash").eqNullSafe(F.col("stays"))
    return rows.join(named, F.col("node") == F.col("k")).withColumn("is_first", first).drop("k", "stays")


def drop_near_duplicates(docs: DataFrame, words: int = 5, n_words: int = 4, radius: int = 72, parts: int = 0, similarity: float = 0.8, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of documents whose sets of shingles are of the given similarity, all columns as they are.

    The radius only chooses the pairs whose sets are compared. Sets of similarity 0.8 differ in 39 of 256 bits on
    average, with a deviation of 6 (the smallest, 4 shingles of 5, in 48), and unrelated texts in 128 with a deviation
    of 8: a radius of 72 is 5 deviations (the smallest sets: 3.8) from the former and 7 from the latter.

    The row that stays is the one of the smallest id (null first), and of these of the smallest hash of its text;
    of repeated rows one stays. Null and empty texts equal each other and nothing else, so one of them stays. Columns
    may have any names; an empty table gives no rows. Very long texts cost what they cost in near_duplicates.
    """
    found = near_duplicates(docs, words, n_words, radius, parts, True, similarity, tile, id_col, text_col, similarity)
    key, none, place, number, stay_id, stay_none, stay_hash = (free_name(docs, f"_dup_{x}") for x in ("key", "none", "hash", "number", "stay_id", "stay_none", "stay_hash"))
    # a null id is told apart by a key of its own: a null-safe comparison would not share the window's exchange of whole rows
    whole = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    stays = found.filter("is_first").select(whole(F.col("doc_id")).alias(stay_id), F.col("doc_id").isNull().alias(stay_none), F.col("text_hash").alias(stay_hash)).distinct()
    marked = docs.withColumn(key, whole(F.col(id_col))).withColumn(none, F.col(id_col).cast("long").isNull()).withColumn(place, F.xxhash64(F.col(text_col)))
    kept = marked.join(stays, (F.col(key) == F.col(stay_id)) & (F.col(none) == F.col(stay_none)) & (F.col(place) == F.col(stay_hash)), "left_semi")
    return kept.withColumn(number, F.row_number().over(Window.partitionBy(key, none, place).orderBy(key))).filter(F.col(number) == 1).select(*docs.columns)
