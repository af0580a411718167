"""Fill-in-the-middle against plain Python over characters, and its SQL."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import infill as I
from sieveline.llm.queries import ORACLE, QUERIES

from tests.conftest import DATA

from .helpers import HARD, frame, same_as_sql, table_of, text

ROWS = [*HARD, *[(100 + k, text(k, k % 50)) for k in range(300)], (900, "a <M> b"), (901, "<P"), (902, "S><S"), (903, "<"), (904, "é\U0001f600" * 400), (905, "\n\n x"), (906, "é" * 9)]


def plain(doc, t, seed=1):
    t = t or ""
    x = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@given(st.text(max_size=300), st.integers(-(2**63), 2**63 - 1))
def test_characters(t, doc):
    n, form, a, m, out = I.rearrange(t.encode("utf-8", "ignore"), doc)
    assert (n, form, a, m, out.decode()) == plain(doc, t.encode("utf-8", "ignore").decode())


@given(st.binary(max_size=400), st.sampled_from(I.UNITS))
def test_marks_and_places(data, unit):
    bits = I.marks(data, unit)
    if unit == "chars":
        want = [k for k, b in enumerate(data) if b & 0xC0 != 0x80]
    elif unit == "words":
        want = [k for k, b in enumerate(data) if b not in I.SPACES and (k == 0 or data[k - 1] in I.SPACES)]
    else:
        want = [k for k in range(len(data)) if k == 0 or data[k - 1] == 10]
    assert bits.bit_count() == len(want)
    assert [I.select(bits, r) for r in range(len(want))] == want


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units_and_markers(spark, unit):
    marks = ("<pre>", "<suf>", "<mid>")
    rows = I.fill_in_middle(frame(spark, ROWS), unit=unit, rate=100, spm=50, seed=9, markers=marks)
    rows = rows.withColumn("back", I.restore(F.col("output"), F.col("form"), marks))
    got = sorted((str(r["doc_id"]), r["back"]) for r in rows.collect())
    assert got == sorted((str(d), t or "") for d, t in ROWS)
    assert {r["form"] for r in rows.collect()} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        I.fill_in_middle(rows, markers=("<a>", "<a>", "<b>"))
    with pytest.raises(ValueError):
        I.fill_in_middle(rows, unit="pages")


def test_hard_rows(spark):
    out = I.fill_in_middle(frame(spark, ROWS))
    got = table_of(out.withColumn("back", I.restore(F.col("output"), F.col("form"))))
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"])) for r in got) == sorted(repr((d, *plain(d, t))) for d, t in ROWS)
    assert sorted((str(r["doc_id"]), r["back"]) for r in got) == sorted((str(d), t or "") for d, t in ROWS)
    assert I.fill_in_middle(frame(spark, [])).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), f"{DATA}/sf0.001"):
        same_as_sql(QUERIES["op11_fill_in_middle"](spark, folder), ORACLE["op11_fill_in_middle"], folder)
