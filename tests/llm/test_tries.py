"""The prefix trie against one made of every prefix of every conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sieveline.llm import tries as T
from sieveline.llm.queries import ORACLE, QUERIES

from tests.conftest import DATA

from .helpers import same_as_sql, text

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, said in rows:
        if conv is not None:
            role, said = role or "", said or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{said}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, said))
    for x in own.values():
        x.sort()
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - int(abs(c) % 5) * (1 if c > 0 else -1)
        made[c] = tuple((r, t) for *_, r, t in own.get(lender, [])[:h] + x[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out, leaves, saved = [], defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        ends = ",".join(str(c) for c in members[p] if len(made[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def conversations(seed, n=120, kinds=3, longest=7):
    """Conversations over a few texts, so that prefixes are shared at every depth."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        if rnd.random() < 0.1:
            continue  # some lenders are absent
        for k in range(rnd.randrange(1, longest)):
            rows.append((c, k, rnd.choice(["user", "user", None]), ["", "é", "a b", None, "longer text", "x"][rnd.randrange(kinds)]))
    return rows


LONG = [(5000, k, "user", text(k % 7, 3)) for k in range(700)] + [(5005, k, "user", text(k % 7, 3) if k < 600 else "other") for k in range(650)]
HARD = [
    (7, None, "user", "b"),
    (7, None, "user", "a"),
    (7, 1, None, None),
    (7, 1, "", ""),
    (7, 1, "", ""),
    (8, 5, "user", "only"),
    (None, 1, "user", "lost"),
    (-3, 1, "user", "minus"),
    (-5, 1, "user", "lent"),
    (-5, 2, "user", "lent"),
    (2**40, 0, "u", text(1, 4000)),
    (2**40 + 1, 0, "u", text(1, 4000)),
]
COPIES = [(6000 + c, k, "user", f"same {k}") for c in range(300) for k in range(3)]
CASES = {
    "shared": conversations(1),
    "few kinds": conversations(2, kinds=1, longest=12),
    "many kinds": conversations(3, kinds=6),
    "hard": HARD,
    "long": LONG + HARD,
    "copies": COPIES + conversations(4, 40),
    "one": [(1, 0, "user", "a")],
    "no turn of its own": [(1, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "b")],
}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, seq string, part string").repartition(3)


def got(df):
    assert set(df.columns) == set(COLUMNS)
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_every_prefix(spark, many_ranges, name):
    want = brute(CASES[name])
    for n in (1, 13):
        many_ranges(n)
        assert got(T.prefix_trie(frame(spark, CASES[name]))) == want


def test_ids_are_joined_in_pieces(spark, many_ranges, monkeypatch):
    many_ranges(6)
    monkeypatch.setattr(T, "CHUNK", 7)
    monkeypatch.setattr(T, "BATCH", 5)
    assert got(T.prefix_trie(frame(spark, CASES["copies"]))) == brute(CASES["copies"])


def test_places_of_turns_over_many_ranges(spark, many_ranges):
    many_ranges(9)
    rows = [(1, None if k % 3 else k // 7, f"{k * 7919 % 100:032x}", k) for k in range(900)] + [(c, 0, "k", 1) for c in range(2, 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, key string, bytes long").repartition(4)
    placed = T.in_turn(turns).collect()
    one = sorted((r["pos"], r["key"]) for r in placed if r["conv_id"] == 1)
    assert [p for p, _ in one] == list(range(900))
    assert [k for _, k in one] == [k for _, _, k, _ in sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
    assert all(r["pos"] == 0 for r in placed if r["conv_id"] > 1)


def test_ranges_cut_anywhere():
    rnd = random.Random(5)
    for _ in range(300):
        seqs = sorted({"".join(rnd.choice("ab") * T.KEY for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(1, 12))})
        cuts = sorted(rnd.randrange(len(seqs) + 1) for _ in range(rnd.randrange(4)))
        parts = [p for a, b in zip([0, *cuts], [*cuts, len(seqs)], strict=True) if (p := seqs[a:b])]
        n_convs, leaves, children, saved = (defaultdict(int) for _ in range(4))
        for k, part in enumerate(parts):
            before = T.common_turns(parts[k - 1][-1], part[0]) if k else -1
            after = T.common_turns(part[-1], parts[k + 1][0]) if k + 1 < len(parts) else -1
            grown = T.Range(k, before, after)
            for s in part:
                grown.put(s, [3] * (len(s) // T.KEY), 2, seqs.index(s), False)
            grown.done()
            for _, depth, name, _, conv, _, n, kids, ends, bytes_, *_ in grown.out:
                at = name or (conv, depth)
                n_convs[at] += n
                children[at] += kids
                leaves[at] += ends
                saved[at] += bytes_
        every = {s[: T.KEY * d] for s in seqs for d in range(len(s) // T.KEY + 1)}
        below = lambda p: [q for q in every if q.startswith(p)]
        count = {p: 2 * sum(s.startswith(p) for s in seqs) for p in every}
        childless = {p for p in every if not any(len(q) == len(p) + T.KEY for q in below(p))}
        want = sorted((count[p], len(childless.intersection(below(p))), sum(len(q) == len(p) + T.KEY for q in below(p)), sum((count[q] - 1) * 3 for q in below(p) if q)) for p in every)
        assert sorted((n_convs[k], leaves[k], children[k], saved[k]) for k in n_convs) == want


def test_empty_table(spark):
    assert T.prefix_trie(frame(spark, [])).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    frame(spark, [r for x in CASES.values() for r in x if x is not LONG]).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (str(tmp_path), f"{DATA}/sf0.001"):
        same_as_sql(QUERIES["op13_patricia_prefix_trie"](spark, folder), ORACLE["op13_patricia_prefix_trie"], folder, ("conversations",))
