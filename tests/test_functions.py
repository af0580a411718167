"""Functions on literal rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import arrow as A
from sieveline.functions import dates
from sieveline.functions import responses as R
from sieveline.functions import text as X
from sieveline.functions import urls as U
from sieveline.functions.dates import normalize_timestamp
from sieveline.functions.language import detect_language


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_str(spark):
    assert apply(spark, ["  a\r\n b\t\x1c c ", "", "   ", None, "x y"], X.clean_str) == ["a b c", None, None, None, "x y"]


def test_label_maps(spark):
    assert apply(spark, ["Promotional", " fraud", "legitimate", "other", "", None], X.map_label_basic) == ["spam", "smishing", "ham", None, None, None]
    assert apply(spark, ["yes", "false", "2", None], lambda c: X.map_binary_label(c, "spam")) == ["spam", "ham", None, None]
    rows = spark.createDataFrame([(0, "0", "1"), (1, "1", "0"), (2, "0", "0"), (3, "", ""), (4, "Smishing", None)], "i int, spam string, smishing string")
    label, rule = X.label_priority(F.col("spam"), F.col("smishing"))
    got = [(r[0], r[1]) for r in rows.orderBy("i").select(label, rule).collect()]
    assert got == [("smishing", "smishing_label==1->smishing"), ("spam", "spam_label==1->spam"), ("ham", "spam_label==0->ham"), (None, "else->unlabeled"), (None, "else->unlabeled")]


def test_language_names(spark):
    assert apply(spark, ["EN", "Spanish", "deu", "Klingon", "", None], X.normalize_language) == ["en", "es", "de", "klingon", None, None]


def test_epoch_and_confidence(spark):
    assert apply(spark, ["0", "1700000000123", "x", None], X.iso_from_epoch_ms) == ["1970-01-01 00:00:00", "2023-11-14 22:13:20", None, None]
    assert apply(spark, [0.125, 0.0, 0.999, None], X.format_confidence, "double") == ["0.12", "", "1.00", ""]


def test_names_and_rules(spark):
    assert apply(spark, ["  A b!!c ", "--", "é"], X.sanitize_token) == ["a-b-c", "na", "na"]
    assert apply(spark, ["1", "0", "true", None, "1.0"], X.ai_flag) == [1, 0, 0, 0, 1]
    rows = spark.createDataFrame([(0, None, "Spam", "spam"), (1, "RULE ", "x", "ham"), (2, None, None, None)], "i int, r string, o string, l string")
    assert [r[0] for r in rows.orderBy("i").select(X.mapping_rule(F.col("r"), F.col("o"), F.col("l"))).collect()] == ["spam->spam", "rule", ""]


def test_valid_message(spark):
    assert apply(spark, ["hi", "", None, "x" * 1600, "x" * 1601, "Forwarded Message: a"], X.is_valid_message) == [True, False, False, True, False, False]


def test_normalize_text(spark):
    got = apply(spark, ["See HTTPS://a.b/c  <URL> now", "mail A@b.com or +34 600 123 456", "pin 12345 <not token>", None], X.normalize_text)
    assert got == ["see url_token url_token now", "mail email_address_token or phone_number_token", "pin number_token <not token>", ""]


def test_key_folds_case_space_tags_and_fonts(spark):
    a, b, c, d, e, f = apply(spark, ["Hello  World", "hello world <OBF_ZWSP>", "", None, "Ｈｅｌｌｏ World", "𝐇ello\u00a0world"], A.message_key)
    assert a == b == e == f and len(a) == 64 and c == d == ""


def test_tokens_and_ngrams(spark):
    assert apply(spark, ["A bc Déf gh"], lambda c: X.ngrams(X.word_tokens(c))) == [["bc", "déf", "gh", "bc déf", "déf gh"]]


@pytest.mark.parametrize(
    ("given", "want", "tags"),
    [
        ("P​o​s​t​a​l: Your package is held.", "Postal: Your package is held.", ["<OBF_ZWSP>"]),
        ("pоstаl: Your package is held.", "postal: Your package is held.", ["<OBF_HOMOGLYPH>"]),
        ("Your package from A M A Z O N has arrived.", "Your package from AMAZON has arrived.", ["<OBF_SPACING>"]),
        ("Update your P.A.Y.P.A.L account now.", "Update your PAYPAL account now.", ["<OBF_PUNCTUATION>"]),
        ("\U0001d57b\U0001d594\U0001d598\U0001d599\U0001d586\U0001d591: Your package is held.", "Postal: Your package is held.", ["<OBF_FONT>"]),
        ("You have an important notice." + "\n" * 10 + "Click here: http://phish.com", "You have an important notice. Click here: http://phish.com", ["<OBF_NEWLINE>"]),
        ("Your package has been successfully delivered to your mailbox.", "Your package has been successfully delivered to your mailbox.", []),
        ("[LINK] [username] <acc> 0000000000", "<URL> <PERSON> <ACCOUNT_NUMBER> <PHONE>", []),
    ],
)
def test_repair(spark, given, want, tags):
    row = A.with_repairs(spark.createDataFrame([(given, "x")], "v string, tags_ string"), "v").first()
    assert (row["text_repaired"], row["tags"]) == (want, tags) and row["v"] == given


def test_repairs_of_many_rows(spark):
    """Steps one after the other, each on what the last left; nulls and texts without anything stay."""
    given = [None, "", "plain text", "а" + chr(0x200B) + "\\n[url]", "x. A B C D\t\nE.F.G.H ok\n\n", "ｆull <Name>", " a\tb ", "café – “ok” 5€", "A\u00a0B\u00a0C\u00a0D", "W_I_N-N.E.R", "0000000000 00000000001"]
    want = [(None, []), ("", []), ("plain text", []), ("a <URL>", ["<OBF_ZWSP>", "<OBF_HOMOGLYPH>"]), ("x. ABCD EFGH ok", ["<OBF_SPACING>", "<OBF_PUNCTUATION>", "<OBF_NEWLINE>"]), ("full <PERSON>", ["<OBF_FONT>"]), ("a b", []), ("café – “ok” 5€", []), ("A B C D", ["<OBF_SPACING>", "<OBF_FONT>"]), ("WINNER", ["<OBF_PUNCTUATION>"]), ("<PHONE> 00000000001", [])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    assert [(r["text_repaired"], r["tags"]) for r in A.with_repairs(df, "v").orderBy("i").collect()] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Notice: Your package 1Z9999999999999999 could not be delivered. Update at http://x.co/ab3x", "Notice: Your package <TRACKING_ID> could not be delivered. Update at <URL>"),
        ("Charge not authorized. If not yours, cancel at https://bank.xyz.online", "Charge not authorized. If not yours, cancel at <URL>"),
        ("Contact us via whatsapp://send?phone=34600000000 or pay with 4532-1234-5678-9012", "Contact us via <URL> or pay with <CREDIT_CARD>"),
        ("Verification token: 550e8400-e29b-41d4-a716-446655440000. Claim at 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "Verification token: <UUID>. Claim at <CRYPTO_ADDRESS>"),
        ("call 600123456 now", "call <PHONE>now"),
        ("<URL> <URL><URL> end", "<URL> end"),
        ("50% off %41", "50% off A"),
    ],
)
def test_mask(given, want):
    assert A.mask(given)[0] == want


def test_masking_twice_changes_nothing_more():
    for text in ("a@b.com and http://x.co/ab3x", "call 600123456 now", "nothing here"):
        once = A.mask(text)[0]
        assert A.mask(once)[0] == once


def test_model_spans_yield_to_patterns():
    assert A.mask("Ann, a@b.com", ((0, 3, "private_person"), (5, 12, "secret"), (0, 3, "no such label"))) == ("<PERSON>, <EMAIL>", 2)


def plain_spans(text):
    """By definition: every pattern over the whole text, each span against all that were chosen."""
    found = sorted((m.start() - m.end(), m.start(), k, m.end(), token) for k, (token, p) in enumerate(A._MASKS) for m in p.finditer(text))
    chosen = []
    for _, a, _, b, token in found:
        if all(b <= s or e <= a for s, e, _ in chosen):
            chosen.append((a, b, token))
    return sorted(chosen)


@settings(max_examples=2000, deadline=None)
@given(t=st.lists(st.sampled_from(["http://", "https://", "://", "a", "é", ".", "@", "b.co", "-", "+", " ", "\n", "_", ":", "8080/", "/", "12", "1234", "5", "(", ")", "ab3x", "x|", "550e8400-e29b-41d4-a716-446655440000", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "0x" + "aB" * 20, "192.168.", "ES91", "2100", "٣", "%", "deadbeef", "-abcd"]), max_size=14).map("".join))
def test_spans_equal_the_patterns(t):
    assert A.mask_spans(t) == plain_spans(t)


def test_masks_take_linear_time():
    import time

    began = time.time()
    for t in ("a.", "http://", "a@", "1", "a-", "http://x:", "://", "1.2.3.4 ", "a@b.co ", ".", "A1", "-", "x@a.", "<URL> "):
        A.mask(t * 50_000)
    assert time.time() - began < 60


def test_model_spans_by_column(spark):
    rows = [(0, "Ann, a@b.com", [(0, 3, "B-private_person"), (5, 12, "secret")]), (1, "no digits here", [(3, 9, "private_date")]), (2, "Ann", None), (3, None, []), (4, "Ann", [(0, 3, "unknown"), (None, 3, "secret"), None])]
    df = spark.createDataFrame(rows, "i int, v string, s array<struct<start:int,end:int,label:string>>")
    got = [(r["text_masked"], r["n_entities"]) for r in A.with_masks(df, "v", spans="s").orderBy("i").collect()]
    assert got == [("<PERSON>, <EMAIL>", 2), ("no <DATE> here", 1), ("Ann", 0), (None, 0), ("Ann", 0)]
    assert apply(spark, ["%41ｂ\x07", None], A.prepared) == ["Ab", None]


def test_arrow_columns(spark):
    assert apply(spark, ["ａb", None, "x", "e\u0301", "½ “q”", "é"], A.nfkc) == ["ab", None, "x", "é", "1⁄2 “q”", "é"]
    df = spark.createDataFrame([(0, "http://a.b/c"), (1, None), (2, "plain"), (3, "deadbeef-abcd-abcd-abcd-abcdefabcdef")], "i int, v string")
    assert [r["text_masked"] for r in A.with_masks(df, "v").orderBy("i").collect()] == ["<URL>", None, "plain", "<UUID>"]


def test_stable_characters_are_stable():
    import unicodedata

    stable = [*map(chr, range(128)), *A._CALM]
    assert len(A._CALM) > 80 and not any(c.isdecimal() for c in A._CALM) and all(unicodedata.normalize("NFKC", f"{a}{b}") == f"{a}{b}" for a in stable for b in "aé´" if b in stable)


def test_names_that_clash(spark):
    df = spark.createDataFrame([("P.A.Y.P.A.L", "k", "m")], "v string, _repair_0 string, _mask_found string")
    assert A.with_masks(A.with_repairs(df, "v"), "text_repaired").first().asDict() == {"v": "P.A.Y.P.A.L", "_repair_0": "k", "_mask_found": "m", "text_repaired": "PAYPAL", "tags": ["<OBF_PUNCTUATION>"], "text_masked": "PAYPAL", "n_entities": 0}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://amazon.es/track", (23, 3.816403, 1, 0, 0, 0)),
        ("http://amzn-track.security-update.xyz/login", (43, 4.423488, 2, 1, 1, 0)),
        ("http://192.168.1.1/payload", (26, 3.796218, 3, 2, 0, 1)),
        ("https://bit.ly/3xY8a", (20, 3.846439, 1, 0, 0, 0)),
        ("http://banco-santander.es.verify-account.tk", (43, 4.219886, 3, 2, 1, 0)),
        ("", (0, 0, 0, 0, 0, 0)),
    ],
)
def test_url_features(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(*[c.alias(n) for n, c in U.url_features(F.col("u")).items()]).first()
    assert tuple(row) == pytest.approx(want, abs=1e-6)


def test_domains(spark):
    assert apply(spark, ["http://u@a.com:80/x", "b.org/y?z", "//c.net", "", None], lambda c: U.domain(c)) == ["u@a.com", "b.org", "c.net", None, None]
    assert apply(spark, ["go http://a.b/c, and x.com/y. and http://a.b/c"], U.extract_urls) == [["http://a.b/c", "x.com/y"]]


def test_timestamps(spark):
    given = ["2014-12-31 10:08", "10:08 AM", "Yesterday 11:29 AM", "hoy 16:45", "nan", "abc", "12/03/2014 10:08", "31/12/2014 10:08", None, "4:10 pm"]
    want = ["2014-12-31T10:08:00", "10:08:00", "11:29:00", "16:45:00", "", "", "2014-12-03T10:08:00", "2014-12-31T10:08:00", "", "16:10:00"]
    assert apply(spark, given, normalize_timestamp) == want
    assert apply(spark, ["12/03/2014 10:08"], lambda c: normalize_timestamp(c, day_first=True)) == ["2014-03-12T10:08:00"]


def test_responses(spark):
    given = ['{"label": "Spam"}', '```json\n{"label": "ham"}\n```', '<think>x</think>{"label":"ham"}', "not smishing but spam", "ERROR: out of memory", "", None, '{"label": "other"} spam']
    assert apply(spark, given, R.label_of_response) == ["spam", "ham", "ham", "smishing", "ham", "ham", "ham", "spam"]
    assert apply(spark, ['x {"theme": 1} y', "none", '```json\n{"a":2}```'], R.annotation_json) == ['{"theme": 1}', None, '{"a":2}']


def test_language_override(spark):
    rows = spark.createDataFrame([("en", "0.5", "es"), ("en", "0.9", "es"), ("unknown", "0.9", "fr"), ("en", "bad", "x")], "l string, c string, a string")
    l, c = R.override_language(F.col("l"), F.col("c"), F.col("a"))
    assert [tuple(r) for r in rows.select(l, c).collect()] == [("es", "LLM"), ("en", "0.9"), ("fr", "LLM"), ("en", "bad")]


def test_language_detection(spark):
    got = apply(spark, ["the cat is on the table", "der Hund ist nicht auf dem Tisch", "el perro está en la mesa", "le chat est sur la table", "", None], lambda c: detect_language(c)[0])
    assert got == ["en", "de", "es", "fr", "unknown", "unknown"]


def test_runs_of_letters_as_sql_tells_them(spark):
    """A run inside a longer one, and one behind a letter beyond ASCII: the library's own repairs and those of the queries."""
    import duckdb

    from sieveline.plans.registry import DOTTED_SQL, REPAIRED, SPACED_SQL

    given = ["xx a b c d yy a b c d e zz", "scición y y y los", "a b c d é a b c d", "w.x.y.z or v.w.x.y.z", "A B C D.E.F.G", "u.v.w.x y z a", "plain", "pa a a a a q a a a a a a a"]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {REPAIRED}, {SPACED_SQL}, {DOTTED_SQL} FROM (SELECT ? AS clean)", [g]).fetchone() for g in given]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    rows = A.with_repairs(df, "v", sql_runs=True).orderBy("i").collect()
    assert [(r["text_repaired"], "<OBF_SPACING>" in r["tags"], "<OBF_PUNCTUATION>" in r["tags"]) for r in rows] == want
    own = [r["text_repaired"] for r in A.with_repairs(df, "v").orderBy("i").collect()]
    assert own[:2] == ["xx abcd yy abcde zz", "scición y y y los"] and want[0][0] == "xx abcd yy abcd e zz"


def test_shapes_hold_what_patterns_parse(spark):
    """Every pattern parses what it writes, in any case, and no text is given to a pattern of another shape."""
    at = "timestamp'2014-03-02 22:08:09'"
    for f in (*dates.FORMATS, *dates.MONTH_FIRST, *dates.DAY_FIRST, *dates.NAMED):
        (said,) = spark.sql(f"SELECT date_format({at}, :f)", {"f": f}).first()
        for text in (said, said.lower(), said.upper()):
            assert re.search(dates.shape(f).replace(r"\z", r"\Z"), text), (f, text)
    plan = spark.range(1).select(normalize_timestamp(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") + plan.count("rlike") >= 15
    odd = ["+12345-01-02", "2014-12-31t10:08:00", "03/02/2014 1:08 pm", "2 ſep 2014", "13/02/2014", "0003/2/2014", "2014-01-02\n", "today 7:05pm", " NaN ", "-2014-01-02"]
    assert apply(spark, odd, normalize_timestamp) == ["+12345-01-02T00:00:00", "2014-12-31T10:08:00", "2014-03-02T13:08:00", "2014-09-02T00:00:00", "2014-02-13T00:00:00", "2014-03-02T00:00:00", "", "19:05:00", "", "-2014-01-02T00:00:00"]


def test_keys_of_settled_texts(spark, monkeypatch):
    """Equal to the keys of any texts, while only texts with tags go through Python."""
    from sieveline.functions.arrow import message_key

    texts = ["Plain", "été 你", "e <OBF_ZWSP>́", "e<OBF_FONT>́ x", "", None, "<OBF_FONT>"]
    assert apply(spark, texts, lambda c: message_key(c, settled=True)) == apply(spark, texts, message_key)
    plan = spark.range(1).select(message_key(F.col("id").cast("string"), settled=True).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "<OBF_" in plan[plan.index("_nfkc(") :].splitlines()[0]


def test_a_batch_is_taken_in_parts():
    """A batch of any size has few of its texts in Python at a time, nulls stay in their places, and an empty batch keeps its type."""
    import pyarrow as pa

    from sieveline.functions import arrow as A

    sizes = []

    def made(part):
        sizes.append(len(part))
        return [None if t is None else t.upper() for t in part]

    given = [None if k % 7 == 0 else f"t{k}" for k in range(2 * A.TEXTS_AT_ONCE + 3)]
    out = A.by_parts(made, pa.string(), pa.array(given, pa.string()))
    assert out.to_pylist() == [t and t.upper() for t in given] and sizes == [A.TEXTS_AT_ONCE, A.TEXTS_AT_ONCE, 3]
    none = A.by_parts(made, pa.string(), pa.array([], pa.string()))
    assert len(none) == 0 and none.type == pa.string()
