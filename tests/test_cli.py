"""The commands, one after the other, on small files."""

import json

import pytest

from sieveline.cli import main, parser

from .test_build import raw_folder
from .test_sources import put


def model(prompts):
    """A theme, and a label by a word."""
    return [json.dumps({"theme": "banking", "urgency_level": "high", "language": "en", "label": "spam" if "free" in p.rpartition("Message: ")[2] else "ham"}) for p in prompts]


def test_commands(spark, tmp_path, capsys):
    raw, out = raw_folder(tmp_path / "raw"), str(tmp_path)
    main(["build", "--raw-dir", str(raw), "--output", f"{out}/built"], spark)
    master = f"{out}/built/master_v1.csv"
    assert "kaggle_spam_ham" in capsys.readouterr().out
    main(["subset", "--input", master, "--output", f"{out}/subset", "--labels", "ham", "spam", "--min-length", "9", "--keep-cols", "text", "canonical_label", "none"], spark)
    assert spark.read.option("header", True).csv(f"{out}/subset").columns == ["text", "canonical_label"]
    main(["enrich", "--input", master, "--output", f"{out}/enriched.parquet", "--call", "tests.test_cli:model"], spark)
    assert {r["theme"] for r in spark.read.parquet(f"{out}/enriched.parquet").collect()} == {"banking"}
    with pytest.raises(ValueError, match="resume"):
        main(["enrich", "--input", master, "--output", f"{out}/enriched.parquet", "--call", "tests.test_cli:model"], spark)
    main(["splits", "--input", f"{out}/enriched.parquet", "--output", f"{out}/splits"], spark)
    assert spark.read.option("header", True).csv(f"{out}/splits").count() == 5
    put(tmp_path / "r.jsonl", json.dumps({"message_id": 1, "raw": {"smish": {"messageContent": "x", "upvotes": 2}}}) + "\n")
    main(["reports", "--input", f"{out}/r.jsonl", "--output", f"{out}/reports"], spark)
    assert "community verified" in capsys.readouterr().out
    put(tmp_path / "p.csv", "model_key,true_label,predicted_label\nm,ham,ham\nm,spam,ham\n")
    main(["scores", "--input", f"{out}/p.csv", "--output", f"{out}/scored"], spark)
    assert spark.read.option("header", True).csv(f"{out}/scored/results").first()["accuracy"] == "0.5"


def test_model_commands(spark, tmp_path):
    rows = [(f"m{k}", ("ham", "spam", "smishing")[k % 3], f"{('dinner home', 'free prize', 'bank link')[k % 3]} number {k % 7}") for k in range(120)]
    spark.createDataFrame(rows, "message_id string, canonical_label string, text string").write.parquet(f"{tmp_path}/m.parquet")
    main(["ml", "--input", f"{tmp_path}/m.parquet", "--output", f"{tmp_path}/ml", "--encoders", "bow", "--classifiers", "nb", "--settings", '{"vocabulary": 100}'], spark)
    assert spark.read.option("header", True).csv(f"{tmp_path}/ml/results").first()["test_accuracy"] == "1.0"
    for _ in range(2):  # the second run has nothing left to ask
        main(["llm", "--input", f"{tmp_path}/m.parquet", "--output", f"{tmp_path}/llm", "--call", "tests.test_cli:model", "--examples", '[["free", "spam"]]', "--test-samples", "9"], spark)
    results = spark.read.option("header", True).csv(f"{tmp_path}/llm/results").collect()
    assert len(results) == 5 and {r["n_samples"] for r in results} == {"9"} and len({r["accuracy"] for r in results}) == 1
    raw = spark.read.option("header", True).csv(f"{tmp_path}/llm/raw_predictions")
    assert raw.count() == 45 and raw.filter("predicted_label = 'spam' and text not like '%free%'").count() == 0


def test_nearest_examples(spark):
    from sieveline.operators.prompting import asked, nearest_examples

    train = spark.createDataFrame([(1, "your bank account is blocked", "smishing"), (2, "dinner at home tonight", "ham"), (3, "free prize for you", "spam"), (4, "bank account news", "ham")], "id long, text string, label string")
    test = spark.createDataFrame([(10, "is my bank account blocked", "ham")], "id long, text string, label string")
    near = nearest_examples(test, train, 2)
    assert [(e["text"], e["label"]) for e in near.first()["examples"]] == [("your bank account is blocked", "smishing"), ("bank account news", "ham")]
    said = asked(test, "dynamic-few-shot_expert_cot", [("a", "ham")], near).first()["prompt"]
    assert said.index("your bank account is blocked") < said.index("bank account news") < said.index("is my bank account blocked")


def test_every_command_has_its_flags(capsys):
    for name in ("build", "reports", "enrich", "subset", "splits", "ml", "scores", "llm"):
        with pytest.raises(SystemExit):
            parser().parse_args([name, "--help"])
        assert "--output" in capsys.readouterr().out
