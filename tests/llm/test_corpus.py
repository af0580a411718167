"""Mixing, sharding, near duplicates, media and the pipeline against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import media as D
from sieveline.llm import mixing as X
from sieveline.llm import sharding as S
from sieveline.llm import simhash as N

from tests.conftest import DATA

from .helpers import HARD, frame, pairs, table_of, text


def water_fill(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Shares by weight; what is over a limit goes to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1}, {"a": 0, "b": 7}, {"a": 0}, {f"s{k}": k * k for k in range(12)}, {"a": 100, "b": 1, "c": 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in X.source_targets(rows).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_mix(spark):
    rows = [*HARD, *[(100 + k, text(k, k % 90)) for k in range(400)]]
    got = table_of(X.in_order(X.mix(frame(spark, rows), slice_rows=20)))
    again = table_of(X.mix(frame(spark, rows).repartition(7), slice_rows=20))
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    want = water_fill({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0]["target"] == pytest.approx(want[s]) and abs(sum(r["taken"] for r in x) - want[s]) < 1.001
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sum(q["size"] for q in x) for r in x)
        assert all((r["position"] is None) == (r["taken"] == 0) for r in x)
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and 0 <= min(places) and max(places) < 1
    assert X.mix(frame(spark, [])).count() == 0


def test_equal_rows_are_dealt_to_many_tasks(spark):
    """A hash that most rows share, in the order of the SQL all the same."""
    rows = [(7, "one two three")] * 6000 + [(100 + k, text(k, k % 40)) for k in range(900)]
    docs = spark.createDataFrame([(i, t, "a" if k % 3 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for made in (X.mix(docs), X.mix(docs, carry={"whole": "text"}).drop("whole")):
            tasks = made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("taken").alias("s")).agg(F.max("n"), F.max("s")).first()[0]
            assert tasks < 1500
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    made = X.mix(docs, slice_rows=20).drop("positions").toPandas()
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(X.MIX_SQL).df()
    columns = sorted(made.columns)
    plain = lambda df: sorted(repr([None if v != v else round(v, 6) if isinstance(v, float) else v for v in r]) for r in df[columns].astype(object).itertuples(index=False))
    assert plain(made) == plain(want)


def test_mix_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    want = con.execute(X.MIX_SQL)
    names = [c[0] for c in want.description]
    got = X.mix(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).drop("positions")
    assert sorted(got.columns) == sorted(names) and got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in names]) for r in got.collect()) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_mixture_carries_whole_rows(spark):
    """Copies as often as the mix takes them, in the order of their positions, with every column; also for many equal rows."""
    rows = [*HARD, *[(100 + k, text(k, 1 + k % 60)) for k in range(200)], *[(7777, text(5, 30))] * 150]
    docs = frame(spark, rows)
    mixed = table_of(X.mix(docs, slice_rows=20, carry={"kept_text": "text"}))
    out = X.mixture(docs, slice_rows=20)
    assert out.columns == docs.columns
    got = table_of(out)
    want = defaultdict(int)
    for r in mixed:
        want[(str(r["doc_id"]), r["kept_text"])] += r["copies"]
    have = defaultdict(int)
    for r in got:
        have[(str(r["doc_id"]), r["text"])] += 1
        assert r["size"] == "x" and r["lang"] == "en"
    assert have == {k: n for k, n in want.items() if n}
    assert X.mixture(frame(spark, [])).count() == 0


def test_positions_follow_the_schedule(spark):
    rows = spark.createDataFrame([(k / 50, s) for k in range(50) for s in ([1.5, 1.0, 0.5], [1.0, 1.0, 1.0], [0.0, 1.0, 2.0])], "share double, schedule array<double>")
    for r in rows.withColumn("t", X.invert(F.col("share"), F.col("schedule"))).collect():
        a, b, c = r["schedule"]
        whole = (a + 2 * b + c) / 4
        grid = np.linspace(0, r["t"], 20_001)
        mass = np.trapezoid(np.interp(grid, [0, 0.5, 1], [a, b, c]), grid)
        assert mass / whole == pytest.approx(r["share"], abs=1e-6)


def brute_capacity(sizes, shards):
    """The smallest feasible capacity, by trying all."""
    low = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        n = at = 0
        used = 1
        for s in sizes:
            if at + s > low:
                used, at = used + 1, 0
            at += s
        if used <= shards:
            return low
        low += 1


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 60), min_size=1, max_size=40), shards=st.integers(1, 9))
def test_smallest_capacity(sizes, shards):
    ranges = S.Ranges([(64, k, s, 1) for k, s in enumerate(sizes)])
    capacity, open_ = ranges.undecided(shards, max(sizes))
    assert capacity == brute_capacity(sizes, shards) and not open_
    ends = ranges.whole(capacity, shards)
    assert len(ends) == shards and ends[-1] == sum(sizes)


@pytest.mark.parametrize("large", [(), (0.1,), (0.34,), (0.02, 0.08, 0.08), (0.05,) * 9, (0.12,) * 6])
def test_driver_holds_a_bounded_number_of_totals(large):
    """Groups of any share of the bytes, 200,000 others: what a round fetches, and that the capacity is the smallest."""
    rng = np.random.default_rng(len(large))
    h = np.sort(rng.integers(0, 2**64, 200_000, np.uint64))
    sizes = rng.integers(1, 5000, len(h))
    for k, share in enumerate(large):
        sizes[(k * 7919 + 4321) % len(h)] = int(share * sizes.sum() / max(0.05, 1 - sum(large)))
    fetched = []

    def totals(chosen):
        out, ranges = [], [(0, 0)] if chosen is None else [(r[0], r[1]) for r in chosen]
        for bits, spot in ranges:
            finer = S.FETCH.bit_length() - 1 if chosen is None else min(64, bits + S.OPENED_BITS)
            lo, hi = np.searchsorted(h, np.array([spot << (64 - bits), ((spot + 1) << (64 - bits)) - 1], np.uint64)) if bits else (0, len(h))
            hi += bool(bits and hi < len(h) and int(h[hi]) == ((spot + 1) << (64 - bits)) - 1)
            keys, at = np.unique(h[lo:hi] >> np.uint64(64 - finer), return_index=True)
            sums, counts = np.add.reduceat(sizes[lo:hi], at), np.diff(np.r_[at, hi - lo])
            out += [(finer, int(a), int(b), int(c)) for a, b, c in zip(keys, sums, counts, strict=True)]
        fetched.append(len(out))
        return out

    cuts = S.cuts_by_totals(totals, 8, int(sizes.max()))
    assert max(fetched) <= S.FETCH and len(fetched) <= 12
    load = np.bincount(np.searchsorted(np.array(cuts, np.int64), (h ^ np.uint64(1 << 63)).view(np.int64)), weights=sizes)
    whole = S.Ranges([(64, int(a), int(b), 1) for a, b in zip(h, sizes, strict=True)])
    assert load.max() == whole.undecided(8, int(sizes.max()))[0]


@pytest.mark.parametrize("n", [0, 1, 3, 100, 3000])
def test_cuts_are_minimax(spark, n):
    rows = spark.range(n).select(F.xxhash64("id").alias("h"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(500)) + 1 + F.when(F.col("id") % 500 == 7, 9000).otherwise(0)).cast("long").alias("bytes"))
    cuts = S.contiguous_cuts(rows, 8)
    if not n:
        assert cuts == []
        return
    order = sorted((r["h"], r["bytes"]) for r in rows.collect())
    load = [0] * 8
    for h, b in order:
        load[sum(h > c for c in cuts)] += b
    assert max(load) == brute_capacity([b for _, b in order], 8)


def test_shards(spark):
    rows = [*HARD, *[(k, text(k % 90, 10 + k % 50)) for k in range(500)], *[(k, "hot") for k in range(1000, 1400)]]
    got = table_of(S.shard_documents(frame(spark, rows), slot_rows=7))
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(8))
    together = defaultdict(set)
    for r in got:
        if r["size"] > 1:
            together[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in together.values())
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert S.shard_documents(frame(spark, [])).count() == 0


def plain_fingerprint(t, words=3):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs(len(nodes)):
        if linked(nodes[i], nodes[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(nodes))]


@pytest.mark.parametrize("tile", [4, 2048])
def test_simhash_components(spark, tile):
    base = text(9, 400).split()
    near = [(500 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 400, 10)]
    rows = [*HARD, *near, *[(200 + k, text(k % 30, 3 + k % 30)) for k in range(80)]]
    got = table_of(N.near_duplicates(frame(spark, rows), tile=tile))
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f, str(least.get(r))) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r["doc_id"]), r["node"] % 2**64, str(r["component_id"])) for r in got) == want
    assert len(set(roots)) < len(set(fps))
    assert N.near_duplicates(frame(spark, [])).count() == 0


def test_links_lose_nothing(spark):
    """Against all pairs, at several radii and part numbers."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for c in centres for _ in range(8)})
    nodes = spark.createDataFrame([(k, bytearray(f.to_bytes(8, "little")), 1) for k, f in enumerate(fps)], "node long, fp binary, n long")
    for radius, parts in ((2, 4), (2, 8), (3, 2), (1, 1), (5, 0)):
        edges = N.links(nodes, radius, parts, tile=16)
        got = {r["node"]: r["root"] for r in N.components(edges).collect()}
        want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= radius)
        assert [got.get(k, k) for k in range(len(fps))] == want


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    ring = [(3000 + k, 3000 + (k + 1) % 50) for k in range(50)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(path + star + ring + [(7000, 7000)], "a long, b long")).collect()}
    assert {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1200)} == {1000} and {got[k] for k in range(3000, 3050)} == {3000}


def jaccard(a, b):
    cut = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_near_copies_go_and_others_stay(spark):
    rows = []
    for k in range(60):
        words = [f"{w}{k}" for w in text(k + 50, 250).split()]
        rows.append((3 * k, " ".join(words)))
        rows.append((3 * k + 1, " ".join([*words[:100], "other", *words[101:]])))
        rows.append((3 * k + 2, " ".join(words[::-1])))
    rows += [(0, rows[0][1]), (None, None), (None, ""), (900, "short one")]
    kept = table_of(N.drop_near_duplicates(frame(spark, rows)))
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted([*range(0, 180, 3), *range(2, 180, 3), 900])
    assert all(jaccard(rows[3 * k][1], rows[3 * k + 1][1]) >= 0.8 for k in range(60))
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert kept[0].keys() == frame(spark).limit(0).toPandas().to_dict().keys()


def test_interleaving():
    digest = "ab" * 32
    page = f'<p>One <b>two</b><script>x</script></p><figure><img src="sha256:{digest}" alt="old"><figcaption>A  cap<i>tion</i></figcaption></figure>three &amp; four<img src="http://x/y.png"><img src="sha256:{digest}">'
    got = D.parse(page)
    assert [(p["position"], p["kind"], p["text"], p["digest"], p["caption"]) for p in got] == [(0, "text", "One two", None, None), (1, "media", None, digest, "A caption"), (2, "text", "three & four", None, None), (3, "media", None, digest, None)]
    assert D.parse(None) == [] and D.parse("") == [] and D.parse("<p><figure><figcaption>open") == []


def test_pages_resolve(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    pages = spark.createDataFrame([(1, f'a<img src="sha256:{digest}">b'), (1, None), (None, f'<img src="sha256:{"0" * 64}">')], "page_id long, html string")
    refs = D.references(D.interleave(pages, "page_id", "html"))
    got = D.resolve(refs, spark.createDataFrame([(digest, 7), (digest, 7)], "digest string, value int"))
    assert sorted((str(r["id"]), r["position"], r["value"]) for r in got.collect()) == [("1", 1, 7), ("None", 0, None)]


@settings(max_examples=400, deadline=None)
@given(html=st.lists(st.sampled_from(["<", ">", "</", "<!", "<![", "<!--", "-->", "]]>", "<![CDATA[", "<![foo bar]>", "<?", "/>", "p", "figure", "figcaption", "img src=", '"sha256:', "'", '"', "=", "&#x", "&amp", "&#99999999999;", " ", "x", "<script>", "</script", "<style", "é", "\n", "<!DOCTYPE [", "<!ELEMENT ["]), max_size=30).map("".join))
def test_broken_markup_is_read(html):
    parts = D.parse(html)
    assert [p["position"] for p in parts] == list(range(len(parts)))


def test_unknown_sections():
    assert [p["text"] for p in D.parse("a<![foo bar]>x<![CDATA[y]]>z<![endif]-->w<![open")] == ["axzw"]
    assert [p["text"] for p in D.parse("1 < 2 <b a='>' c=\">\" d=>3</b x><title>a &lt;b> c</TITLE >d<script>e</script f>g<!-->h<p")] == ["1 < 2 3a <b> cdgh"]


def test_long_broken_pages_take_linear_time():
    import time

    began = time.time()
    for t in ("<", "<a", "<!", "<a ", "</", "<![", "&#", "<!--", '<a b="', "<a b='", "<?", "<script>", "<a =", "<a/", "x&amp;<p>"):
        D.parse(t * 200_000)
    assert time.time() - began < 60


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.sampled_from(["a", " ", "&amp;", "<b>", "</b>", "<p>", "</p>", "<br/>", "<!-- <i> -->", "<i class='x y' id=z checked>", "</i>", "<script>var a = '<p>';</script>", "<!DOCTYPE html>", "&eacute;", "<img alt=\"q>\" src=x>"]), max_size=20))
def test_tokens_equal_the_standard_parser(parts):
    """On well-formed markup."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def handle_starttag(self, tag, attrs):
            said.append(("start", tag, {k: v or "" for k, v in attrs}))

        def handle_endtag(self, tag):
            said.append(("end", tag, {}))

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)

        def handle_data(self, data):
            said.append(("text", data, {}))

    def joined(tokens):
        out = []
        for t in tokens:
            if t[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + t[1], {})
            else:
                out.append(t)
        return out

    said = []
    reader = Plain(convert_charrefs=True)
    reader.feed("".join(parts))
    reader.close()
    assert joined(D.tokens("".join(parts))) == joined(said)


def test_real_pages(spark):
    """Every page of the table, with a picture put into it, against a plain reading of its text."""
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    digest = hashlib.sha256(b"y").hexdigest()
    with_media = pages.withColumn("html", F.concat(F.replace("html", F.lit("<article>"), F.lit(f'<figure><img src="sha256:{digest}"><figcaption>seen</figcaption></figure><article>')), F.lit("<![odd")))
    got = table_of(D.interleave(with_media, "page_id", "html", ("url",)))
    assert len(got) == pages.count() and all(r["url"] for r in got)
    for r in got:
        media = [p for p in r["parts"] if p["kind"] == "media"]
        assert [(p["digest"], p["caption"]) for p in media] == [(digest, "seen")]
        assert [p["position"] for p in r["parts"]] == list(range(len(r["parts"])))
        texts = [p["text"] for p in r["parts"] if p["kind"] == "text"]
        assert len(texts) > 3 and not any("track(" in t or "margin:0" in t for t in texts)
    refs = D.references(D.interleave(with_media, "page_id", "html"))
    known = spark.createDataFrame([(digest, 5)], "digest string, value int")
    assert [r["value"] for r in D.resolve(refs, known).collect()] == [5] * pages.count()


@settings(max_examples=50, deadline=None)
@given(octets=st.binary(max_size=2000))
def test_pictures_round_trip(octets):
    payload = D.pad(octets)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(octets)
    assert D.from_picture(D.to_picture(payload)) == payload


def plain_feature(p):
    step = sum(abs(p[k] - p[k + 1]) for k in range(len(p) - 1) if (k + 1) % 24)
    levels = [sum(32 * j <= x < 32 * j + 32 for x in p) for j in range(8)]
    return f"n={len(p)};sum={sum(p)};squares={sum(x * x for x in p)};step={step};levels=" + ",".join(map(str, levels))


def test_media_of_hard_rows(spark):
    got = table_of(D.store_and_resolve(frame(spark)))
    assert len(got) == len(HARD)
    want = []
    for i, t in HARD:
        p = D.pad((t or "").encode())
        form = D.to_picture(p)
        want.append((str(i), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(form), hashlib.sha256(form).hexdigest(), plain_feature(p), int(bool((t or "").strip())), f"{len((t or '').encode())} bytes"))
    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got) == sorted(want)
    assert D.store_and_resolve(frame(spark, [])).count() == 0


def test_written_folders_can_be_cleared(spark):
    import os

    from sieveline.llm.common import clear, new_path

    path = new_path(spark, "cleared")
    spark.range(3).write.parquet(path)
    place = path.removeprefix("file://")
    assert os.path.isdir(place) and clear(spark, [path]) == 1 and not os.path.exists(place) and clear(spark, [path]) == 0


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept."""
    import corpus_pipeline as C

    clean = [(k, text(k + 300, 90 + k)) for k in range(120)]
    junk = [(1000 + k, text(k, 80).replace(" ", " ** ")) for k in range(40)]
    copies = [(2000 + k, clean[k][1]) for k in range(30)]
    private = [(3000, text(900, 100) + " mail me@there.org")]
    rows = clean + junk + copies + private + [(None, None), (4000, "")]
    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 1000 <= i < 2000), 0) for i, _ in clean + junk], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None, {}
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns or name == "packing"
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = docs.collect()
    good = {r["doc_id"] for r in kept["quality rules"]}
    assert good == {i for i, _ in clean + copies + private}
    assert {r["doc_id"] for r in kept["near duplicates"]} == {i for i, _ in clean + private} and len(kept["near duplicates"]) == 121
    hidden = next(r for r in kept["personal data"] if r["doc_id"] == 3000)
    assert hidden["text"].endswith("mail <EMAIL>") and hidden["n_chars"] == len(hidden["text"])
    words = lambda x: sum(len(r["text"].encode().split()) for r in x)
    assert words(kept["mixture"]) == pytest.approx(1.5 * words(kept["personal data"]), rel=0.1)
    assert {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["mixture"]}
    assert C.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    frame(spark, [], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_similarity_and_radius_agree():
    """Of pairs at a similarity of 0.8, the radius misses few; unrelated texts are far."""
    rng = np.random.default_rng(3)
    far = missed = 0
    for _ in range(60):
        common, own = rng.integers(0, 2**63, 320, dtype=np.uint64), rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = np.concatenate([common, own[:40]]), np.concatenate([common, own[40:]])
        bits = lambda h: [N.majority(N._widen(h, k)) for k in range(4)]
        missed += sum((x ^ y).bit_count() for x, y in zip(bits(a), bits(b))) > 56
        far += sum((x ^ y).bit_count() for x, y in zip(bits(a), bits(own))) <= 56
    assert missed <= 1 and far == 0 and math.isclose(320 / 400, 0.8)


def test_recall_against_all_pairs_of_a_table(spark):
    """The classes of sf0.01 by sharing five-word shingles, every pair with a common shingle looked at."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    cut = lambda t: {b" ".join(w[k : k + 5]) for w in [(t or "").encode().lower().split()] for k in range(max(1, len(w) - 4))}
    sets = [cut(t) for _, t in rows]
    holders, common, parent = defaultdict(list), defaultdict(int), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        for s in own:
            for other in holders[s]:
                common[(other, k)] += 1
            holders[s].append(k)
    pairs_found = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs_found:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    want = {min(i for (i, _), k in zip(rows, range(len(rows))) if root(k) == r) for r in {root(k) for k in range(len(rows))}}
    kept = {r["doc_id"] for r in N.drop_near_duplicates(docs).select("doc_id").collect()}
    assert len(pairs_found) >= 50 and any(sets[a] != sets[b] for a, b in pairs_found)
    assert kept == want


@pytest.mark.parametrize("tile", [3, 2048])
def test_only_pairs_of_the_contracts_similarity_go(spark, tile):
    """Pairs at 0.5 to 0.79 stay, those from 0.8 up go, also in long chains and in small sets; components are those of all pairs."""
    rows = []
    for k in range(40):
        words = [f"{w}{k}" for w in text(k + 700, 120 + k).split()]
        # the tail is another text's: similarities from about 0.5 to about 0.95
        shared = len(words) * (68 + k * 3 // 4) // 100
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:shared], *(f"{w}x{k}" for w in text(k + 900, len(words) - shared).split())]))]
    base = text(77, 200).split()
    base = [f"{w}{k}" for k, w in enumerate(base)]
    rows += [(1000 + k, " ".join(base[k * 10 : k * 10 + 104])) for k in range(10)]
    rows += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i"), (2002, "a b c d e f g"), (2003, "a b c d e f"), (2004, "a b c d e"), (2005, "a b c d"), (2006, ""), (2007, None), (2008, " "), (2009, "one two"), (2009, "one two")]
    roots = plain_components([t or "" for _, t in rows], lambda a, b: jaccard(a, b) >= 0.8)
    seen = [jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(40)]
    assert sum(0.56 <= j < 0.8 for j in seen) >= 10 and sum(j >= 0.8 for j in seen) >= 5
    want = sorted(min(i for (i, _), r in zip(rows, roots) if r == root) for root in set(roots))
    assert sorted(r["doc_id"] for r in table_of(N.drop_near_duplicates(frame(spark, rows), tile=tile))) == want


def test_media_columns_may_have_any_names(spark):
    refs = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, None, 2)], "id long, digest string, position int")
    media = spark.createDataFrame([("a", 7, 8, 9, "x"), ("c", 1, 1, 1, "y")], "digest string, d int, dh int, position int, _media_hash string")
    got = sorted((r["id"], r["digest"], r["position"], r["d"], r["dh"], r["_media_hash"]) for r in D.resolve(refs, media).collect())
    assert got == [(1, "a", 0, 7, 8, "x"), (2, "b", 1, None, None, None), (3, None, 2, None, None, None)]
    with pytest.raises(ValueError, match="parts"):
        D.interleave(refs, "id", "digest", ("Parts",))
