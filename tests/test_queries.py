"""Every query with SQL against DuckDB, and the driver's entry."""

import decimal

import duckdb
import pytest

from sieveline.plans.catalog import ORACLE, QUERIES

from .conftest import DATA

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = duck.execute(ORACLE[name])
    said = [c[0] for c in found.description]
    assert sorted(said) == names
    want = [tuple(plain(r[said.index(c)]) for c in names) for r in found.fetchall()]
    assert sorted(map(repr, [tuple(plain(r[c]) for c in names) for r in got.collect()])) == sorted(map(repr, want))


def test_masked_documents_hold_no_links(spark):
    rows = QUERIES["anonymize_full"](spark, SF)
    assert rows.count() == 200 and rows.filter("text_anonymized rlike 'https?://[a-z]'").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_model_queries_use_the_operators_settings(spark, monkeypatch):
    from sieveline.operators import ml

    seen = []
    monkeypatch.setattr(ml, "prepare", lambda rows: rows)
    monkeypatch.setattr(ml, "evaluate", lambda df, encoder, classifier, settings=None: seen.append((encoder, classifier, settings)) or (spark.createDataFrame([("test", "ham", "ham")], "split string, true_label string, predicted_label string"), 0.0))
    for name in QUERIES:
        if name.startswith("ml_grid_"):
            QUERIES[name](spark, SF)
    assert sorted((e, c) for e, c, _ in seen) == sorted((e, c) for e in ml.ENCODERS for c in ml.CLASSIFIERS)
    assert not any(settings for _, _, settings in seen)


def test_all_grams_hold_the_rare_ones(spark):
    every, frequent = QUERIES["bigrams_all"](spark, SF), QUERIES["bigrams_count"](spark, SF)
    assert every.filter("n = 1").count() and every.filter("n between 2 and 19").count()
    assert every.filter("n >= 20").exceptAll(frequent).count() == 0 and frequent.exceptAll(every).count() == 0


def _documents(spark, path, texts, parts):
    rows = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(parts).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    got = QUERIES["stream_dedupe_available_now"](spark, _documents(spark, tmp_path, ["one", "two", "One", "three"], 3))
    assert got.count() == 3


def test_answers_name_no_class_that_only_the_message_names(spark, tmp_path):
    texts = ["spam smishing"] * 8 + ["lesèpament vi", "Smisheding SPAM"] * 8
    con = duckdb.connect()
    where = _documents(spark, tmp_path, texts, 2)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    got = QUERIES["response_label_parse"](spark, where).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == sorted(con.execute(ORACLE["response_label_parse"]).fetchall())


def test_iterations_have_no_more_tasks_than_cores(spark):
    """Each iteration of a fit moves a vector of the vocabulary's width from every task."""
    from sieveline.operators import ml

    most = max(ml.TASKS, spark.sparkContext.defaultParallelism)
    assert [ml._tasks(spark, n) for n in (0, 1, 5_000, 5_001, 10_000_000)] == [1, 1, 1, 2, most]


@pytest.mark.parametrize("name", ["dedupe_first_wins", "dedupe_ledger_anti"])
@pytest.mark.parametrize("others", [["one"], ["one", None], ["one", " "], [], [None]])
def test_documents_without_a_text_are_what_sql_makes_of_them(spark, tmp_path, name, others):
    """GROUP BY has one group of unset keys; NOT IN finds nothing where the ledger holds an unset key."""
    where = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(["one", None, "two", " ", "Two", "", None])], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(others)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "two")] if others else [], "conv_id long, turn int, role string, text string").write.parquet(f"{where}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, where).select("doc_id", "dedupe_key").collect()]
    assert sorted(got, key=repr) == sorted(con.execute(ORACLE[name]).fetchall(), key=repr)
