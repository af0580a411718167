"""The stream and the batch build have one key for one message."""

from pyspark.sql import functions as F

from sieveline.operators import build as B
from sieveline.plans.curation import keyed
from sieveline.functions import text as X
from sieveline.sources.catalog import RAW
from sieveline.streaming.incremental import run_available


def test_stream_and_build_agree(spark, tmp_path):
    texts = ["A M A Z O N offer", "AMAZON offer", "amazon  OFFER", "P.A.Y.P.A.L now", "PAYPAL now", "Ｐaypal now", "pоstаl", "postal", "p​ostal", "x" * 1700, None, "other"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    run_available(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/state")
    stream = {r["dedupe_key"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    raw = rows.select(*[(F.col("text") if f.name == "text" else F.lit("uci_sms_spam") if f.name == "source" else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
    batch = {r["dedupe_key"] for r in B.build(raw).collect()}
    flagship = {r["dedupe_key"] for r in keyed(X.once(rows, {"clean": X.clean_str(F.col("text"))}).filter(X.is_valid_message(F.col("clean")))).collect()}
    assert stream == batch == flagship and len(stream) == 4
