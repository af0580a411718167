"""Ids against the library, packing against its constraints, planes as an exact round trip, longest match by brute force."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm.packing import Capacities, best_fit, pack, pack_pieces, pieces
from sieveline.llm.planes import encode_and_read, encode_segments, find_documents, from_planes, read_document, read_segment, to_planes, write_dataset, write_segment
from sieveline.llm.tokens import Encoder, separable
from sieveline.llm.wordpiece import LongestMatch, count_tokens, sentence_pieces

from .helpers import HARD, frame, table_of, text

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return Encoder(PATH)


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(t=st.text(alphabet=st.sampled_from(list("ab Zé  \n\t.,'sl!<|>_-12²\u00a0\u0085ß漢")), max_size=40))
def test_ids_equal_the_library(library, mine, t):
    assert list(np.frombuffer(mine.encode(t), "<u4")) == ids_of(library, t)


def test_hard_ids_equal_the_library(library, mine):
    for _, t in HARD:
        assert list(np.frombuffer(mine.encode(t or ""), "<u4")) == ids_of(library, t)


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 100), min_size=1, max_size=60), docs=st.integers(1, 8), score=st.sampled_from(["norm", "dot"]))
def test_every_capacity_holds(lengths, docs, score):
    cap = Capacities(100, docs, 100 * 100 // 2)
    x = np.array(lengths)
    bins, offsets = best_fit(x, cap, score=score)
    by = defaultdict(list)
    for n, b, o in zip(x, bins, offsets):
        by[b].append((o, n))
    for members in by.values():
        members.sort()
        assert [o for o, _ in members] == [sum(n for _, n in members[:k]) for k in range(len(members))]
        if len(members) > 1:
            assert sum(n for _, n in members) <= 100 and len(members) <= docs and sum(n * n for _, n in members) <= 5000


def plain_best_fit(lengths, cap, weights, score):
    """Vector best fit by its definition: every bin ever opened is looked at for every piece."""
    limit = np.array([cap.tokens, cap.documents, cap.attention], float)
    sizes = [np.array([n, 1, n * n], float) / limit for n in lengths]
    left, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -sum(w * x for w, x in zip(weights, sizes[i]))):
        options = []
        for b, r in enumerate(left):
            after = r - sizes[i]
            if (after >= -1e-12).all():
                value = sum(w * x * x for w, x in zip(weights, after)) if score == "norm" else -sum(w * x * y for w, x, y in zip(weights, r, sizes[i]))
                options.append((round(value, 12), b))
        if options:
            b = min(options)[1]
            left[b] = left[b] - sizes[i]
        else:
            b = len(left)
            left.append(1.0 - sizes[i])
        out[i] = b
    return [out[i] for i in range(len(lengths))]


@settings(max_examples=150, deadline=None)
@given(lengths=st.lists(st.integers(1, 100), min_size=1, max_size=70), docs=st.integers(1, 6), cost=st.integers(3_000, 10_000), score=st.sampled_from(["norm", "dot"]))
def test_best_fit_equals_its_definition(lengths, docs, cost, score):
    """With document and attention capacities that bind."""
    cap, weights = Capacities(100, docs, cost), (1.0, 0.25, 0.5)
    assert best_fit(np.array(lengths), cap, weights, score)[0].tolist() == plain_best_fit(lengths, cap, weights, score)


def test_packing_under_binding_capacities(spark, library):
    rows = [(k, text(k, 3 + k * 7 % 400)) for k in range(300)]
    cap = Capacities(2048, 3, 1_500_000)
    got = table_of(pack(frame(spark, rows), PATH, cap, block_docs=64))
    check_pieces(got, rows, library)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r["length"])
    assert all(len(x) == 1 or (len(x) <= 3 and sum(n * n for n in x) <= 1_500_000) for x in by.values())
    assert sum(len(x) == 3 for x in by.values()) > 10 and any(1_300_000 < sum(n * n for n in x) for x in by.values() if len(x) > 1)


def test_wished_capacities_cost_no_sequence(spark, library):
    """Many short documents: few of them in a sequence would cost many sequences."""
    rows = [(k, text(k, 5 + k % 700 if k % 4 == 0 else 2)) for k in range(600)]
    count = lambda wished: len({r["sequence_id"] for r in table_of(pack(frame(spark, rows), PATH, block_docs=100, wished=wished))})
    got = table_of(pack(frame(spark, rows), PATH, block_docs=100, wished=Capacities(2048, 8, 2048 * 2048 * 9 // 10)))
    check_pieces(got, rows, library)
    assert len({r["sequence_id"] for r in got}) <= count(None) + 1


def test_wishes_cost_no_sequence_of_a_whole_table(spark):
    """4,936 is what the ids of all documents fill at least."""
    from sieveline.llm.queries import QUERIES
    from tests.conftest import DATA

    got = QUERIES["op1_best_fit_packing"](spark, f"{DATA}/sf0.1").groupBy("sequence_id").agg(F.sum("length").alias("n"))
    n, most, every = got.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert most <= 2048 and -(-every // 2048) <= n <= 4937


def test_pieces_of_one_text_are_dealt_to_blocks(spark):
    items = pieces(spark.createDataFrame([(1, text(1, 60_000))], "doc_id long, text string"), PATH, 2048)
    blocks = pack_pieces(items, 8, Capacities()).select("sequence_id").distinct().collect()
    assert len({r["sequence_id"] >> 32 for r in blocks}) > 4


def test_large_ids_beside_nulls(spark, library):
    rows = [(2**53 + 1, "a b"), (None, "c"), (2**60 + 1, "d e f"), (-(2**63), None), (2**63 - 1, "")]
    got = table_of(pack(frame(spark, rows).coalesce(1), PATH))
    check_pieces(got, rows, library)
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}


def test_packing_is_tight_and_whole(spark, library):
    rows = [(k, text(k, 5 + k % 700)) for k in range(400)]
    got = table_of(pack(frame(spark, rows), PATH, block_docs=64))
    check_pieces(got, rows, library)
    used = defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert len(used) <= 1.01 * -(-sum(used.values()) // 2048) + 2


def check_pieces(got, rows, library):
    want = defaultdict(int)
    for i, t in rows:
        ids = [*ids_of(library, t), 0]
        first = (len(ids) - 1) % 2048 + 1
        at = k = 0
        while at < len(ids):
            stop = first if not at else at + 2048
            part = ids[at:stop]
            want[(i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
            at, k = stop, k + 1
    have = defaultdict(int)
    by = defaultdict(list)
    for r in got:
        have[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for members in by.values():
        at = 0
        for o, n in sorted(members):
            assert o == at
            at += n
        assert at <= 2048


def test_packing_of_hard_rows(spark, library):
    check_pieces(table_of(pack(frame(spark), PATH)), HARD, library)
    assert pack(frame(spark, []), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(docs=st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=50)), max_size=8), kind=st.sampled_from(["bytes", "bits"]), block=st.sampled_from([1, 7, 64]))
def test_segments_round_trip(docs, kind, block):
    payload = write_segment([(d, np.array(x, "<u4").tobytes()) for d, x in docs], kind, block)
    index, ids = read_segment(payload)
    assert [(int(r["doc_id"]) if r["known"] else None, int(r["n"])) for r in index] == [(d, len(x)) for d, x in docs]
    assert ids.tolist() == [v for _, x in docs for v in x]


@settings(max_examples=40, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), min_size=1, max_size=8), kind=st.sampled_from(["bytes", "bits"]), block=st.sampled_from([1, 7, 64]))
def test_one_document_by_the_index(docs, kind, block):
    payload = write_segment([(k, np.array(x, "<u4").tobytes()) for k, x in enumerate(docs)], kind, block)
    for k, x in enumerate(docs):
        assert read_document(payload, k).tolist() == x
    with pytest.raises(IndexError):
        read_document(payload, len(docs))


def test_index_spares_other_blocks():
    """A block that is not asked for may be damaged."""
    payload = bytearray(write_segment([(0, np.arange(100, dtype="<u4").tobytes()), (1, np.arange(100, dtype="<u4").tobytes())], "bytes", 100))
    payload[-4:] = b"xxxx"
    assert read_document(bytes(payload), 0).tolist() == list(range(100))
    with pytest.raises(Exception):  # noqa: B017
        read_document(bytes(payload), 1)


def test_documents_are_found(spark, library, tmp_path):
    write_dataset(frame(spark), str(tmp_path / "planes"), PATH, segment_ids=500)
    segments = spark.read.parquet(str(tmp_path / "planes"))
    got = sorted((r["doc_id"], r["ids"]) for r in table_of(find_documents(segments, [7, 8, 2, 999])))
    assert got == sorted((i, [*ids_of(library, t), 2]) for i, t in HARD if i in (7, 8, 2))


def test_other_vocabularies_are_encoded_whole(library, mine):
    import json

    assert mine.by_parts
    config = json.loads(library.to_str())
    assert separable(config)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**config["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None}, {"added_tokens": [{**config["added_tokens"][0], "content": "ab"}]}, {"model": {**config["model"], "ignore_merges": True}}):
        assert not separable({**config, **change})
    other = public_tokenizers.path("word_bpe_49k.json")
    theirs, own = Tokenizer.from_file(other), Encoder(other)
    assert not own.by_parts
    for _, t in HARD:
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == theirs.encode(t or "", add_special_tokens=False).ids


def test_equal_rows_are_several_ranges(spark):
    rows = spark.createDataFrame([(5, "equal rows of one document")] * 3000 + [(k, text(k, 9)) for k in range(300)], "doc_id long, text string").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        found = encode_segments(rows, PATH, segment_ids=1000).groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in found) == 3300 and max(r["n"] for r in found) < 800


def test_planes_are_exact():
    x = np.array([0, 1, 2**31, 2**32 - 1, 50256], "<u4")
    for kind in ("bytes", "bits"):
        assert from_planes(to_planes(x, kind), len(x), kind).tolist() == x.tolist()


def test_dataset_of_hard_rows(spark, library):
    got = sorted(table_of(encode_and_read(frame(spark), PATH, segment_ids=500)), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in got[:2]] == [None, None]
    want = sorted((i is not None, i or 0, len(ids_of(library, t)) + 1, zlib.crc32(np.array([*ids_of(library, t), 2], "<u4").tobytes())) for i, t in HARD)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert encode_and_read(frame(spark, []), PATH).count() == 0


def greedy(pieces, word):
    """Longest piece first, over and over; what none begins costs its bytes."""
    n = at = 0
    while at < len(word):
        stop = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        n += 1 if stop else len(word[at].encode())
        at = stop or at + 1
    return n


@settings(max_examples=300, deadline=None)
@given(pieces=st.sets(st.text(alphabet="abé", min_size=1, max_size=5), max_size=12), word=st.text(alphabet="abéz", max_size=20))
def test_longest_match_equals_brute_force(pieces, word):
    assert LongestMatch(pieces).count(word) == greedy(pieces, word)


def test_counts_of_hard_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(sentence_pieces(path))
    want = sorted((str(i), len((t or "").encode().split()), sum(greedy(pieces, "▁" + w.decode()) for w in (t or "").encode().split())) for i, t in HARD if len(t or "") < 8000 and "xxxx" not in (t or ""))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in table_of(count_tokens(frame(spark), path)))
    assert len(got) == len(HARD) and set(want) <= set(got)
    assert count_tokens(frame(spark, []), path).count() == 0
