"""Enrichment: annotations and domain records joined to messages, resumable by anti joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.responses import annotation, annotation_prompt, override_language, validated_annotation
from ..sources.adapters import answer
from ..sources.shared import exists, new_path
from ..sources.writers import as_text


def needs_annotation(df: DataFrame) -> DataFrame:
    return df.filter(F.trim(F.coalesce("theme", F.lit(""))) == "")


def best_domain(messages: DataFrame, records: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """(id, domain, tld, age_days, hidden, country): the record of the highest score among a message's URLs, ties by domain; messages without a known domain have none.

    records: (domain, age_days, hidden, country), one row a domain. Only ids and domains move, and the records' side
    is left to the optimizer: the table of domains grows with the corpus.
    """
    found = messages.select(F.col(id_col).alias("id"), F.explode(U.extract_urls(F.col(text_col))).alias("url"))
    named = found.select("id", U.domain(F.col("url")).alias("domain")).dropna().distinct()
    scored = named.join(records, "domain").withColumn("score", U.whois_score(F.col("hidden"), F.col("age_days")))
    best = scored.groupBy("id").agg(F.min_by(F.struct("domain", "age_days", "hidden", "country"), F.struct(-F.col("score"), F.col("domain"))).alias("w"))
    return best.select("id", "w.domain", U.tld(F.col("w.domain")).alias("tld"), "w.age_days", "w.hidden", "w.country")


def annotate(master: DataFrame, annotations: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Fills theme, urgency_level, language and language_confidence of rows without a theme from (id, theme, urgency, language) answers."""
    theme, urgency, language = validated_annotation(F.col("_theme"), F.col("_urgency"), F.col("_language"))
    answers = annotations.select(F.col(id_col).alias("_id"), F.col("theme").alias("_theme"), F.col("urgency").alias("_urgency"), F.col("language").alias("_language"))
    todo = F.trim(F.coalesce("theme", F.lit(""))) == ""
    hit = todo & F.col("_id").isNotNull()
    lang, conf = override_language(F.col("language"), F.col("language_confidence"), language)
    joined = master.join(answers, F.col(id_col) == F.col("_id"), "left")
    return joined.withColumns({"theme": F.when(hit, theme).otherwise(F.col("theme")), "urgency_level": F.when(hit, urgency).otherwise(F.col("urgency_level")), "language": F.when(hit, lang).otherwise(F.col("language")), "language_confidence": F.when(hit, conf).otherwise(F.col("language_confidence").cast("string"))}).select(*master.columns)


def latest(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row an id, the last by order: a retried row replaces the one that failed."""
    return df.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys), keys, "left_anti")


#: Themes and domains that mark a row for another try.
FAILED = ("ERROR", "ERROR_PARSING", "ERROR_INFERENCE")


def enriched(rows: DataFrame, call: Callable[[Sequence[str]], Sequence[str]], records: DataFrame, model: str, version: str, date: str, batch: int = 128) -> DataFrame:
    """Master rows (text columns) with annotations of a model and the best domain record of each message.

    A row with a theme is not asked about again. A call that fails marks its rows' theme ERROR_INFERENCE, so that a
    later run tries them anew. Answers are written once, to the shared folder, whatever is made of them. records:
    (domain, age_days, hidden, country), one row a domain.
    """
    spark = rows.sparkSession
    todo = needs_annotation(rows).filter(F.trim("text") != "")
    said = new_path(spark, "annotations")
    answer(todo.select("message_id", annotation_prompt(F.col("text")).alias("prompt")), call, "message_id", "prompt", batch).write.parquet(said)
    asked = spark.read.schema("message_id string, response string").parquet(said)
    theme, urgency, language = annotation(F.col("response"))
    failed = F.col("response").startswith("ERROR:")
    answers = asked.select("message_id", theme.alias("theme"), urgency.alias("urgency"), language.alias("language"), failed.alias("_failed"))
    out = annotate(rows, answers.drop("_failed"))
    known = answers.select(F.col("message_id").alias("_asked"), "_failed")
    named = best_domain(rows, records).select(F.col("id").alias("_id"), "domain", "tld", "age_days", "hidden", "country")
    out = out.join(known, F.col("message_id") == F.col("_asked"), "left").join(named, F.col("message_id") == F.col("_id"), "left")
    hit, found, lost = F.col("_asked").isNotNull(), F.col("_id").isNotNull(), F.coalesce("_failed", F.lit(False))
    set_to = {
        "theme": F.when(lost, "ERROR_INFERENCE").otherwise(F.col("theme")),
        "llm_model": F.when(hit, model).otherwise(F.col("llm_model")),
        "prompt_version": F.when(hit, version).otherwise(F.col("prompt_version")),
        "llm_annotation_date": F.when(hit, date).otherwise(F.col("llm_annotation_date")),
        "whois_domain": F.when(found, F.col("domain")).otherwise(F.col("whois_domain")),
        "whois_tld": F.when(found, F.col("tld")).otherwise(F.col("whois_tld")),
        "whois_age_days": F.when(found, F.when(F.col("age_days") >= 0, F.col("age_days").cast("string")).otherwise("")).otherwise(F.col("whois_age_days")),
        "whois_hidden": F.when(found, F.col("hidden").cast("int").cast("string")).otherwise(F.col("whois_hidden")),
        "whois_country": F.when(found, F.col("country")).otherwise(F.col("whois_country")),
    }
    return out.withColumns(set_to).select(*rows.columns)


def run_enrichment(spark: SparkSession, master: DataFrame, path: str, call: Callable[[Sequence[str]], Sequence[str]], records: DataFrame, model: str, version: str, date: str) -> DataFrame:
    """Enriches what path (Parquet) lacks or holds with an error, appends it, and returns one row a message, the last of each."""
    before = spark.read.parquet(path) if exists(spark, path) else None
    todo, attempt = master, 0
    if before is not None:
        good = before.filter(~F.col("whois_domain").isin(*FAILED) & ~F.col("theme").isin(*FAILED))
        todo = pending(master, good, ["message_id"])
        attempt = before.agg(F.max("attempt")).first()[0] + 1
    new = enriched(as_text(todo), call, records, model, version, date)
    new.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(path)
    return latest(spark.read.parquet(path), "message_id", "attempt").drop("attempt")
