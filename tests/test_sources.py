"""Readers and writers on files, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.sources import loaders as L
from sieveline.sources.catalog import RECORD_ORDER, SOURCES
from sieveline.sources import writers as W
from sieveline.streaming.incremental import run_available


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ordinal").collect()]


def test_labeled_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'LABEL,TEXT,URL\nHam,"hello, ""you""\nthere",x\n,no label,\nSmishing,pay now,\nHam,too,many,fields\nSpam,,\n')
    got = L.LOADERS["mishra_soni_2022"](spark, p)
    assert rows(got, "source_id", "text", "canonical_label", "language_hint") == [("1", 'hello, "you" there', "ham", "en"), ("3", "pay now", "smishing", "en")]
    assert got.first()["license"] == "research_use"


def test_tab_separated_without_header(spark, tmp_path):
    p = put(tmp_path / "u.tsv", "ham\tGo until\nspam\tFree entry\n")
    assert rows(L.LOADERS["uci_sms_spam"](spark, p), "text", "canonical_label") == [("Go until", "ham"), ("Free entry", "spam")]


def test_priority_keeps_unlabeled(spark, tmp_path):
    p = put(tmp_path / "h.csv", "message,spam label,smishing label\na,0,1\nb,1,0\nc,0,0\nd,,\n")
    got = rows(L.priority_csv(spark, p), "text", "canonical_label", "original_label", "label_mapping_rule")
    assert got[0] == ("a", "smishing", "spam_label=0;smishing_label=1", "smishing_label==1->smishing")
    assert got[3] == ("d", None, "spam_label=;smishing_label=", "else->unlabeled") and len(got) == 4


def test_header_with_a_space(spark, tmp_path):
    p = put(tmp_path / "s.csv", "mensaje, tipo\nhola,ham\n")
    assert rows(L.LOADERS["spanish_spam_ham"](spark, p), "text", "canonical_label") == [("hola", "ham")]


def test_constant_labels(spark, tmp_path):
    p = put(tmp_path / "k.csv", "label,category,text\nphishing,bank,a\n,,b\n")
    assert rows(L.phishing_csv(spark, p), "original_label", "label_mapping_rule") == [("phishing:bank", "implicit_smishing"), ("phishing", "implicit_smishing")]
    p = put(tmp_path / "t.csv", "text,translation,language,time\n,hello,Spanish,10:08\nhola,,es,\n")
    assert rows(L.translated_csv(spark, p), "text", "language_hint", "timestamp_original") == [("hello", "es", "10:08"), ("hola", "es", None)]
    p = put(tmp_path / "c.csv", "TEXT-ENG,TYPE,SLANG,COMPANY,Length_value,Num_writing_errors,Phone,URL\nx,,0,Acme,1,2,,y\n")
    assert rows(L.typed_csv(spark, p), "original_label") == [("unknown [SLANG=0;COMPANY=Acme;Length_value=1;Num_writing_errors=2;Phone=;URL=y]",)]


def test_latin1(spark, tmp_path):
    p = put(tmp_path / "m.csv", "TEXT,7_CLASSES,13_CLASSES,DATASET\ncafé,1,,z\n", "latin-1")
    assert rows(L.classed_csv(spark, p), "text", "original_label", "label_mapping_rule") == [("café", "7class=1;13class=unknown;dataset=z", None)]


def test_binary(spark, tmp_path):
    p = put(tmp_path / "b.csv", "x,message,label,ai_generated\n1,a,1,1\n2,b,no,\n3,c,2,0\n")
    assert rows(L.binary_csv(spark, p), "text", "canonical_label", "is_ai_generated", "label_mapping_rule") == [("a", "spam", 1, "label==1->spam"), ("b", "ham", 0, "label==no->ham")]


def test_nested_json(spark, tmp_path):
    p = put(tmp_path / "n.json", json.dumps({"smsCorpus": {"message": [{"@id": 7, "text": {"$": " hi "}}, {"text": "plain"}, {"@id": 9, "text": ""}, {"@id": 10, "text": 123}]}}))
    assert rows(L.nested_json(spark, p), "source_id", "text", "canonical_label") == [("7", "hi", "ham"), ("2", "plain", "ham"), ("10", "123", "ham")]


def test_positional(spark, tmp_path):
    put(tmp_path / "USER 1.csv", "\ufeffSMS,receive,1,2,03/12/2014 10:08,5,SPAM,win, now\nSMS,send,,,x,,HAM\nno,label\n", "utf-8")
    got = rows(L.positional_csv(spark, str(tmp_path / "USER *.csv")), "text", "canonical_label", "timestamp_original", "source_id")
    assert got == [("win now", "spam", "03/12/2014 10:08", "1"), ("send", "ham", None, "2")]


def test_records_of_any_width(spark, tmp_path):
    """300 cells of text, and the reader's replacement of broken bytes."""
    long = ",".join(["SMS", "in", "", "", "1/2/2014 10:08", "5", "HAM", *(f"w{k}" for k in range(300))])
    (tmp_path / "USER 1.csv").write_bytes(long.encode() + b'\n\nSMS,in,,,,1,spam,"two\nlines, ""q"" \xff",end\n')
    got = rows(L.positional_csv(spark, str(tmp_path / "USER *.csv")), "text", "source_id", "canonical_label")
    assert got == [(" ".join(f"w{k}" for k in range(300)), "1", "ham"), ('two lines, "q" \ufffd end', "3", "spam")]


def test_places_are_counted_by_file_in_the_order_of_names(spark, tmp_path):
    """A small first file and a large second one, which a scan packs the other way round."""
    put(tmp_path / "USER 1.csv", "".join(f"SMS,in,,,,1,ham,first {k}\n" for k in range(3)))
    put(tmp_path / "USER 10.csv", "".join(f"SMS,in,,,,1,ham,tenth {k}\n" for k in range(5)))
    put(tmp_path / "USER 2.csv", "".join(f"SMS,in,,,,1,ham,{'second ' * 200}{k}\n" for k in range(400)))
    got = L.positional_csv(spark, str(tmp_path / "USER *.csv")).orderBy(*RECORD_ORDER).collect()
    assert [r["text"] for r in got[:8]] == [f"first {k}" for k in range(3)] + [f"tenth {k}" for k in range(5)]
    assert [r["source_id"] for r in got] == [str(k + 1) for n in (3, 5, 400) for k in range(n)]


def test_places_of_csv_with_a_header(spark, tmp_path):
    put(tmp_path / "b1.csv", "target,text\n" + "".join(f"ham,small {k}\n" for k in range(2)))
    put(tmp_path / "b2.csv", "target,text\n" + "".join(f"ham,{'large ' * 100}{k}\n" for k in range(200)))
    got = L.LOADERS["kaggle_spam_ham"](spark, str(tmp_path / "b*.csv")).orderBy(*RECORD_ORDER).collect()
    assert [r["source_id"] for r in got] == [str(k + 1) for n in (2, 200) for k in range(n)] and got[0]["text"] == "small 0"


def test_sources_stand_in_the_order_of_loading(spark, tmp_path):
    assert list(L.LOADERS) == [n for n, _, _ in SOURCES] == list(L.PLACES)
    folder = tmp_path / "raw"
    (folder / "spanish_spam_ham").mkdir(parents=True)
    put(folder / "spanish_spam_ham" / "train.csv", "mensaje,tipo\nuno,ham\n")
    put(folder / "spanish_spam_ham" / "test.csv", "mensaje,tipo\ncero,ham\n")
    put(folder / "kaggle_unknown_combined_spam_ham.csv", "target,text\nspam,x\n")
    put(folder / "agarwal_2025_fishing_smishing.csv", "text,translation,language,time\ny,,en,\n")
    got = L.read_sources(spark, L.paths_below(str(folder))).orderBy(*RECORD_ORDER).collect()
    assert [(r["source"], r["text"]) for r in got] == [("kaggle_spam_ham", "x"), ("agarwal_2025", "y"), ("spanish_spam_ham", "uno"), ("spanish_spam_ham", "cero")]


def test_reports(spark):
    smish = lambda **x: json.dumps({"message_id": 3, "raw": {"smish": x}})
    lines = [smish(messageContent="a", timeSubmitted=1700000000123, upvotes=2), "", "{broken", smish(messageContent="", rawText="b", downvotes="1", messageID="m"), smish(messageContent=" ")]
    got = L.report_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "reports", "https://example.org/").collect()
    assert [(r["text"], r["source_id"], r["timestamp_original"], r["original_label"]) for r in got] == [("a", "3", "2023-11-14 22:13:20", "smishing (community verified)"), ("b", "m", "", "unlabeled (community rejected/downvoted)")]


def test_missing_sources_are_left_out(spark, tmp_path):
    p = put(tmp_path / "a.csv", "target,text\nspam,x\n")
    got = L.read_sources(spark, {"kaggle_spam_ham": p, "uci_sms_spam": str(tmp_path / "none.tsv")})
    assert [(r["source"], r["source_rank"]) for r in got.collect()] == [("kaggle_spam_ham", 3)]


def test_master_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m1", 'say "hi",\nyou', None)], "message_id string, text string, theme string")
    W.write_master(df, str(tmp_path / "out"))
    W.write_master(df, str(tmp_path / "out"), mode="append")
    back = W.read_master(spark, str(tmp_path / "absent"), str(tmp_path / "out")).collect()
    assert len(back) == 2 and back[0]["text"] == 'say "hi",\nyou' and back[0]["theme"] in ("", None) and len(back[0]) == 26
    assert W.output_name("x", dedupe=False, with_ai=True) == "x_nodedupe_with_ai.csv"


def test_small_writers(spark, tmp_path):
    df = spark.createDataFrame([("train", 'a "b",\nc', 1), ("val", "d", 2), ("test", None, 3)], "split string, text string, n int")
    W.write_splits(df, str(tmp_path / "splits"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "splits"))
    assert {r["split"]: r["n"] for r in back.collect()} == {"train": "1", "val": "2", "test": "3"} and (tmp_path / "splits" / "split=val").is_dir()
    W.write_json_lines(df, str(tmp_path / "lines"))
    W.write_json_lines(df.limit(1), str(tmp_path / "lines"))
    said = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(said) == 4 and sum(x["n"] == 1 for x in said) == 2 and not any("text" in x for x in said if x["n"] == 3)
    W.write_audit(df, str(tmp_path / "audit"))
    assert '"n"' in "".join(p.read_text() for p in (tmp_path / "audit").glob("*.csv"))
    counts = W.write_subset(spark.createDataFrame([("ham", "x"), ("ham", "y"), ("spam", "z"), (None, "w")], "canonical_label string, text string"), str(tmp_path / "subset"))
    assert [tuple(r) for r in counts.collect()] == [(None, 4), ("ham", 2), ("", 1), ("spam", 1)]
    assert [tuple(r) for r in W.write_subset(df.select("n"), str(tmp_path / "subset2")).collect()] == [(None, 3)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    from sieveline.streaming.incremental import windowed_counts

    src = str(tmp_path / "events")
    schema = "event_type string, ts timestamp, value double"
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:05:00', 1.0D), ('a', timestamp'2024-01-01 00:50:00', 2.5D), ('b', timestamp'2024-01-01 01:10:00', 1.0D), ('a', timestamp'2024-01-01 03:00:00', 7.0D) AS t(event_type, ts, value)").coalesce(1).write.parquet(src)
    q = windowed_counts(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r["window"]["start"]), r["event_type"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [("2024-01-01 00:00:00", "a", 2, 3.5), ("2024-01-01 01:00:00", "b", 1, 1.0)]


def test_stream_folds_fonts(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "Pay Now"), (2, "Ｐａｙ Ｎｏｗ"), (3, "𝐩ay now")], "i int, text string").coalesce(1)
    df.write.parquet(src)
    run_available(spark, src, df.schema, out, state)
    assert spark.read.parquet(out).count() == 1


def test_stream_resumes_and_refuses_other_options(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "Hello"), (2, "hello "), (3, "x")], "i int, text string")
    df.write.parquet(src)
    run_available(spark, src, df.schema, out, state, {"dedupe": True})
    spark.createDataFrame([(4, "HELLO"), (5, "new")], "i int, text string").write.mode("append").parquet(src)
    run_available(spark, src, df.schema, out, state, {"dedupe": True})
    assert sorted(r[0] for r in spark.read.parquet(out).select(F.lower(F.trim("text"))).collect()) == ["hello", "new", "x"]
    with pytest.raises(ValueError, match="differ"):
        run_available(spark, src, df.schema, out, state, {"dedupe": False})


def test_files_of_the_round_trip_are_dealt_once_and_compressed(spark, tmp_path):
    """Rows that are dealt by folder are written as they lie, a file a folder, and read back in their order."""
    from sieveline.plans.assembly import _put_files

    rows = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("folder"), F.concat(F.lit("line\n"), F.col("id").cast("string")).alias("text")).repartition(3, "folder").sortWithinPartitions("folder", "doc_id").persist()
    found = L.labeled_csv(spark, _put_files(rows, f"{tmp_path}/x", {"label": F.lit("ham"), "text": F.col("text")}), "uci_sms_spam", ("label",), ("text",))
    assert len(list(tmp_path.glob("x/folder=*/*.csv.gz"))) == 3
    assert {(r["text"], r["ordinal"]) for r in found.collect()} == {(f"line {k}", k // 3 + 1) for k in range(60)}


def test_sources_are_written_a_task_a_folder_and_side_by_side(spark, monkeypatch):
    """Two folders must not share a task, and no source waits for another's files."""
    import threading

    from sieveline.plans import assembly

    dealt, lock, running, most = set(), threading.Lock(), [0], [0]
    put = assembly._put_files

    def seen(rows, path, cells, **options):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            if not dealt:
                dealt.update((r["p"], r["folder"]) for r in rows.select(F.spark_partition_id().alias("p"), "folder").distinct().collect())
        out = put(rows, path, cells, **options)
        with lock:
            running[0] -= 1
        return out

    monkeypatch.setattr(assembly, "_put_files", seen)
    assembly.sources_round_trip(spark, "/root/testdata/sf0.001")
    assert dealt == {(0, 0), (1, 1), (2, 2)} and most[0] > 1
