"""The span tagger: tags and spans, decoding by brute force, held-out scores, the build with a trained model."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.operators import build as B
from sieveline.operators import tagger as G
from sieveline.sources.catalog import RAW
from sieveline.sources.writers import read_master

FIRST = "Anna Bruno Carla Dario Elena Felix Greta Hugo Irene Jonas Karin Lukas Marta Nils Olga Pablo".split()
LAST = "Abbot Baker Costa Dunne Evans Frank Gomez Hardy Ivanov Jansen Keller Lopez Moreau Novak Ortiz Price".split()
STREETS = "Oak Elm High Mill Park Lake Hill Bridge".split()
FRAMES = (
    "Dear {p}, your parcel is waiting at {a}. Thank you",
    "hello {p} please call back about the order",
    "The bill for {p} was sent to {a} on Monday",
    "Meet at the station at noon. Bring the Blue Folder",
    "Mr {p} lives near {a}, as far as I know.",
    "Your appointment with Dr {p} is confirmed",
    "New Offer: buy one, get one free at the Old Shop",
)


def example(rnd, first, last):
    frame, spans, out = rnd.choice(FRAMES), [], ""
    for part in frame.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if part == "{p}":
            said = rnd.choice([f"{rnd.choice(first)} {rnd.choice(last)}", rnd.choice(last)])
            spans.append((len(out), len(out) + len(said), "private_person"))
        elif part == "{a}":
            said = f"{rnd.randrange(1, 99)} {rnd.choice(STREETS)} {rnd.choice(['Street', 'Road'])}"
            spans.append((len(out), len(out) + len(said), "private_address"))
        else:
            said = part
        out += said
    return out, spans


def labelled(spark, seed, n, first, last):
    rnd = random.Random(seed)
    return spark.createDataFrame([example(rnd, first, last) for _ in range(n)], "text string, spans array<struct<start:int,end:int,label:string>>")


@pytest.fixture(scope="module")
def model(spark):
    return G.train(labelled(spark, 1, 400, FIRST[:10], LAST[:10]), a_task=100, bits=14)


def test_held_out_names(spark, model):
    """Names that training never saw, in texts that it never saw."""
    rows = labelled(spark, 2, 300, FIRST[10:], LAST[10:]).withColumn("found", G.span_column(model)(F.col("text")))
    got = {r["label"]: r for r in G.span_scores(rows).collect()}
    assert got[None]["f1"] > 0.95 and got["private_person"]["f1"] > 0.9 and got["private_address"]["f1"] > 0.9


def test_training_agrees_with_itself_and_is_kept(spark, model, tmp_path):
    rows = labelled(spark, 1, 400, FIRST[:10], LAST[:10]).repartition(7)
    again = G.train(rows, a_task=100, bits=14)
    assert np.allclose(again.weights, model.weights, atol=1e-5)
    model.save(spark, f"{tmp_path}/model")
    held = G.SpanTagger.load(spark, f"{tmp_path}/model")
    assert np.array_equal(held.weights, model.weights) and (held.labels, held.bits) == (model.labels, model.bits)
    assert G.train(rows.limit(0), bits=10).spans("Dear Anna Abbot, hello") == []


def test_a_pass_by_definition():
    """One task's pass against sums over its steps."""
    rnd = random.Random(3)
    texts = [example(rnd, FIRST, LAST) for _ in range(20)]
    held = [(G.features([t[a:b] for a, b in G.tokens(t)], 10), G.tags_of(G.tokens(t), s, G.LABELS)) for t, s in texts]
    start = np.zeros(((1 << 10) + 33, 33), np.float32)
    after, mean = G.passed(start, 10, held)
    own, every = start.astype(float), np.zeros(start.shape)
    allowed, first, last = G.steps(8)
    for places, gold in held:
        guess = G.decode(own[places].sum(axis=1), allowed + own[1 << 10 :], first, last)
        for tags, sign in ((gold, 1), (guess, -1)):
            for k in range(len(tags)):
                for p in places[k]:
                    own[p, tags[k]] += sign
                if k:
                    own[(1 << 10) + tags[k - 1], tags[k]] += sign
        every += own
    assert np.array_equal(after, own) and np.allclose(mean, every / len(held))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10**6))
def test_decoding_is_the_best_of_all(n, seed):
    rng = np.random.default_rng(seed)
    allowed, first, last = G.steps(2)
    emitted, moves = rng.normal(size=(n, 9)), allowed + rng.normal(size=(9, 9))
    score = lambda tags: sum(emitted[k, t] for k, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags)) + first[tags[0]] + last[tags[-1]]
    best = max(itertools.product(range(9), repeat=n), key=score)
    assert tuple(G.decode(emitted, moves, first, last)) == best


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4), st.sampled_from(["a", "b"])), max_size=5))
def test_tags_and_spans_round_trip(spans):
    said = "zero one two three four five six seven eight nine ten eleven twelve"
    places = G.tokens(said)
    given, free = [], 0
    for start, n, label in sorted(spans):
        if start >= free and start + n <= len(places):
            given.append((places[start][0], places[start + n - 1][1], label))
            free = start + n
    tags = G.tags_of(places, given, ("a", "b"))
    assert G.spans_of(tags, places, ("a", "b")) == given
    allowed, first, last = G.steps(2)
    assert all(allowed[a, b] == 0 for a, b in itertools.pairwise(tags)) and first[tags[0]] == 0 == last[tags[-1]]


def test_long_texts_are_decoded_in_stretches(model, monkeypatch):
    rnd = random.Random(4)
    said = " ".join(example(rnd, FIRST, LAST)[0] for _ in range(60))
    whole = model.spans(said)
    monkeypatch.setattr(G, "STRETCH", 64)
    assert len(whole) > 40 and len(set(whole) ^ set(model.spans(said))) <= 2
    assert model.spans("") == model.spans("  ") == []


def test_the_build_takes_a_trained_model(spark, model, tmp_path):
    model.save(spark, f"{tmp_path}/model")
    rows = [("Dear Ortiz, your parcel is waiting at 5 Oak Street. Thank you", "ham"), ("hello Hugo Novak please call back about the order", "ham")]
    raw = spark.createDataFrame([(t, c) for t, c in rows], "text string, canonical_label string")
    raw = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit("uci_sms_spam") if f.name == "source" else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
    path = B.run_records(raw, str(tmp_path / "out"), B.Build(span_model=f"{tmp_path}/model"))
    assert path.endswith("_privacy.csv")
    got = {r["text_anonymized"] for r in read_master(spark, path).collect()}
    assert got == {"Dear <PERSON>, your parcel is waiting at <ADDRESS>. Thank you", "hello <PERSON> please call back about the order"}
