"""Callables on executors, pages of a service, registry answers."""

import json

from pyspark.sql import functions as F

from sieveline.functions import responses as R
from sieveline.functions import urls as U
from sieveline.sources import adapters as A


def test_answers_and_errors(spark):
    rows = spark.createDataFrame([(1, "Message: verify your account"), (2, "Message: hello"), (3, " "), (4, None), (5, "Message: win a prize")], "id int, p string").coalesce(1)
    got = {r["id"]: r["l"] for r in A.answer(rows, A.keyword_model, "id", "p", batch=2).withColumn("l", R.label_of_response(F.col("response"))).collect()}
    assert got == {1: "smishing", 2: "ham", 3: "ham", 4: "ham", 5: "spam"}

    def broken(prompts):
        raise RuntimeError("out of memory")

    assert {r["response"] for r in A.answer(rows, broken, "id", "p").collect()} == {"ERROR: out of memory"}


def test_pages(spark):
    plan = A.page_plan(spark, 1, 1200, 500)
    assert sorted(tuple(r) for r in plan.collect()) == [(1, 500), (501, 1000), (1001, 1200)]

    def fetch(i):
        if i == 7:
            raise OSError("down")
        return json.dumps({"message_id": i}) if i <= 640 and i % 90 else None

    got = A.fetch_pages(plan, fetch).cache()
    assert got.count() == 1200 and [tuple(r) for r in got.filter("error is not null").collect()] == [(7, None, "down")]
    assert A.end_of_service(got) == 640
    assert A.end_of_service(got.filter("message_id <= 640")) is None
    assert A.end_of_service(got.filter("message_id > 900")) == 900
    assert A.last_id(got.select(F.col("payload").alias("value")).filter("value is not null")) == 640
    assert A.last_id(spark.createDataFrame([], "value string")) == 0


def test_domain_records(spark):
    answers = [
        {"isRegistered": True, "dates": {"created": "2024-01-01T04:00:00Z"}, "registrar": {"name": "R"}, "contacts": {"registrant": {"redacted": False, "organization": "Privacy Ltd", "address": {"country": "ES"}}}},
        {"isRegistered": True, "registrar": {}, "contacts": {"registrant": {"redacted": True}}},
        {"isRegistered": False, "dates": {"created": "2024-01-01"}},
        {},
    ]
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], "i int, j string")
    got = rows.orderBy("i").select(*[c.alias(n) for n, c in U.domain_record(F.col("j"), F.lit("2024-01-31").cast("date")).items()]).collect()
    assert [tuple(r) for r in got] == [(30, True, "ES", "R"), (-1, True, "Unknown", "Unknown"), (-1, False, "Unknown", "Unknown"), (-1, False, "Unknown", "Unknown")]
