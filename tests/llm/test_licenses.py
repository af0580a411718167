"""License scans against every block compared with every template."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import licenses as L
from sieveline.llm.queries import ORACLE, QUERIES

from tests.conftest import DATA

from .helpers import HARD, frame, same_as_sql, table_of, text

FULL = dict((label, t) for label, t in L.TEMPLATES)  # the last of each label


def shortened(t, keep, seed):
    words = t.split()
    gone = set(random.Random(seed).sample(range(len(words)), round(len(words) * (1 - keep))))
    return " ".join(w for k, w in enumerate(words) if k not in gone)


ROWS = [
    *HARD,
    *[(200 + k, text(k, 40 + 7 * k) + "\n# " + t.upper() + "\n" + text(k + 1, 300)) for k, (_, t) in enumerate(L.TEMPLATES)],
    *[(300 + k, text(k, 500) + " " + shortened(t, 0.9, k)) for k, (_, t) in enumerate(L.TEMPLATES)],
    *[(400 + k, shortened(t, 0.6, k)) for k, (_, t) in enumerate(L.TEMPLATES)],
    (500, "MIT License MIT license\tmit\n\nLICENSE, the mit-license; general public license apache licensé apache license"),
    (501, "license mit general public"),
    (502, " ".join(["under the of a this"] * 3000)),
    (503, FULL["gpl"] * 40),
    (504, "mit license"),
]


def brute(t, least=0.8, templates=L.TEMPLATES, phrases=L.PHRASES):
    words = L.words_of((t or "").encode())
    base = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == [x.encode() for x in p.split()]]
    found = []
    for label, said in templates:
        mine = L.words_of(said.encode())
        width = 2
        while width < 2 * len(mine):
            width *= 2
        for at in range(0, len(words), width // 2):
            share = len(set(mine) & set(words[at : at + width])) / len(set(mine))
            if share >= least - 1e-12:
                found.append((at, min(at + width, len(words)), label, share))
    return words, base, sorted(found)


def expected(doc, t, **options):
    words, base, found = brute(t, **options)
    places, labels = [i for i, _ in base], {x for _, x in base}
    return (doc, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[2] for f in found})), round(1.0 if base else max([f[3] for f in found], default=0.0), 9), [(f[2], f[0], f[1], round(f[3], 9)) for f in found])


def rows_of(df):
    return sorted(repr((*[r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")], round(r["score"], 9), [(f["label"], f["start"], f["end"], round(f["containment"], 9)) for f in r["found"]])) for r in table_of(df))


def test_equals_all_pairs(spark):
    for least in (0.8, 0.5, 1.0):
        got = rows_of(L.scan(frame(spark, ROWS), least=least))
        assert got == sorted(repr(expected(d, t, least=least)) for d, t in ROWS)
    assert L.scan(frame(spark, [])).count() == 0


def test_every_template_is_found_in_other_text(spark):
    got = {r["doc_id"]: r for r in L.scan(frame(spark, ROWS)).collect()}
    for k, (label, _) in enumerate(L.TEMPLATES):
        assert label in got[200 + k]["labels"].split(",") and got[200 + k]["score"] == 1.0
    assert got[502]["labels"] == "" and got[12]["labels"] == "" and got[500]["n_base"] == 6


words = st.lists(st.sampled_from("a b c d e f g h i j k l m n o p".split()), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(words.filter(bool), min_size=1, max_size=6), words, st.sampled_from([0.3, 0.5, 0.8, 1.0]), st.randoms())
def test_filters_lose_nothing(templates, said, least, rnd):
    known = [L.template(str(k), " ".join(t), least) for k, t in enumerate(templates)]
    every = sorted({w for t in known for w in t.words})
    rnd.shuffle(every)
    order = {w: k for k, w in enumerate(every)}
    document = [w.encode() for w in said]
    got = set()
    for width in {t.width for t in known}:
        index = L.Index(width, [(t.label, sorted(order[w] for w in t.words), t.need) for t in known if t.width == width])
        places = [k for k, w in enumerate(document) if w in order]
        got |= {(label, at) for label, at, _, _ in index.search(places, [order[document[k]] for k in places], len(document))}
    want = set()
    for t in known:
        assert t.need == max(1, math.ceil(round(least * len(t.words), 9)))
        for at in range(0, len(document), t.width // 2):
            if len(t.words & set(document[at : at + t.width])) >= t.need:
                want.add((t.label, at))
    assert got == want


def test_query_equals_its_sql(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), f"{DATA}/sf0.001"):
        same_as_sql(QUERIES["op12_license_containment"](spark, folder), ORACLE["op12_license_containment"], folder)
