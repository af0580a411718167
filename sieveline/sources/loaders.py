"""One reader a source shape. All yield the columns of `catalog.RAW`; `ordinal` is a record's place in its file, from 1, counted before anything is filtered."""

from __future__ import annotations

import csv
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_str, free, iso_from_epoch_ms, label_priority, map_binary_label, map_label_basic, normalize_language, once
from .catalog import ADDRESS, LICENSE, RANK, RAW
from .shared import exists


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds file and ordinal, a row's place in its file from 1, to a frame straight from a scan that gives each file to one task. A row a file meets the rows: its first number in its task."""
    numbered = df.withColumn("file", F.col("_metadata.file_path")).withColumn("_place", F.monotonically_increasing_id())
    first = numbered.groupBy(F.col("file").alias("_file")).agg(F.min("_place").alias("_first"))
    return numbered.join(first, F.col("file") == F.col("_file")).withColumn("ordinal", F.col("_place") - F.col("_first") + 1).drop("_place", "_file", "_first")


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", header: bool = True, names: Sequence[str] | None = None, encoding: str = "UTF-8", below: bool = False) -> DataFrame:
    """Everything as text; quoted fields may span lines; records with too many fields are left out, missing ones are null. below: files of folders further down too."""
    paths = list(path) if not isinstance(path, str) else path
    options = dict(header=header, sep=sep, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE", columnPruning=False, nullValue="\u0000", emptyValue="", maxCharsPerColumn=-1, recursiveFileLookup=below)
    names = list(names or [c.lstrip("\ufeff") for c in spark.read.options(**options).csv(paths).columns])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_extra"]])
    return spark.read.options(**options).schema(schema).csv(paths).filter(F.col("_extra").isNull()).drop("_extra")


def pick(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that exist, cleaned; header spaces don't count."""
    found = {c.strip(): c for c in df.columns}
    have = [clean_str(F.col(f"`{found[n]}`")) for n in names if n in found]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def raw(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """df as raw records of a source; columns that are not given are null. Texts are worked out once, for their filter too."""
    if "text" in columns:
        (held,) = free(df, "_text")
        df, columns = once(df, {held: columns["text"]}), columns | {"text": F.col(held)}
    columns = {"source": F.lit(source), "part": F.lit(0), "file": F.col("file") if "file" in df.columns else F.lit(""), "source_id": F.col("ordinal").cast("string"), "source_url": F.lit(ADDRESS.get(source)), "license": F.lit(LICENSE.get(source)), "source_rank": F.lit(RANK.get(source)), "ordinal": F.col("ordinal"), **columns}
    out = df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
    return out.filter(F.col("text").isNotNull())


def labeled_csv(spark: SparkSession, path: str, source: str, label: Sequence[str], text: Sequence[str], hint: str | None = None, **options) -> DataFrame:
    """A column of class words and one of texts: the shape of most sources."""
    df = with_ordinal(read_csv(spark, path, **options))
    original = pick(df, *label)
    canonical = map_label_basic(original)
    return raw(df, source, text=pick(df, *text), canonical_label=canonical, original_label=original, language_hint=F.lit(hint)).filter(F.col("canonical_label").isNotNull())


def priority_csv(spark: SparkSession, path: str, source: str = "hosseinpour_2025") -> DataFrame:
    df = with_ordinal(read_csv(spark, path))
    spam, smishing = (F.coalesce(pick(df, f"{k} label", f"{k}_label"), F.lit("")) for k in ("spam", "smishing"))
    label, rule = label_priority(spam, smishing)
    original = F.concat(F.lit("spam_label="), spam, F.lit(";smishing_label="), smishing)
    return raw(df, source, text=pick(df, "message"), canonical_label=label, original_label=original, label_mapping_rule=rule)


def phishing_csv(spark: SparkSession, path: str, source: str = "kaggle_phishing") -> DataFrame:
    df = with_ordinal(read_csv(spark, path))
    original = F.concat_ws(":", F.coalesce(pick(df, "label"), F.lit("phishing")), pick(df, "category"))
    return raw(df, source, text=pick(df, "text"), canonical_label=F.lit("smishing"), original_label=original, label_mapping_rule=F.lit("implicit_smishing"))


def translated_csv(spark: SparkSession, path: str, source: str = "agarwal_2025") -> DataFrame:
    df = with_ordinal(read_csv(spark, path))
    smishing = F.lit("smishing")
    return raw(df, source, text=pick(df, "text", "translation"), canonical_label=smishing, original_label=smishing, timestamp_original=pick(df, "time"), label_mapping_rule=F.lit("implicit_smishing"), language_hint=normalize_language(pick(df, "language")))


def nested_json(spark: SparkSession, path: str, source: str = "nus_sms") -> DataFrame:
    """smsCorpus.message[]: a text is a scalar, or an object that holds it under $."""
    schema = "smsCorpus struct<message:array<struct<`@id`:string,text:string>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    m = df.select(F.col("_metadata.file_path").alias("file"), F.posexplode("smsCorpus.message").alias("at", "m")).select("file", (F.col("at") + 1).cast("long").alias("ordinal"), "m.*")
    text = F.when(F.col("text").startswith("{"), F.coalesce(F.get_json_object("text", "$.$"), F.get_json_object("text", "$['$']"))).otherwise(F.col("text"))
    ham = F.lit("ham")
    return raw(m, source, text=clean_str(text), canonical_label=ham, original_label=ham, label_mapping_rule=F.lit("implicit_ham"), source_id=F.coalesce(clean_str(F.col("`@id`")), F.col("ordinal").cast("string")), language_hint=F.lit("en"))


def records(spark: SparkSession, path: str | Sequence[str], batch: int = 4096) -> DataFrame:
    """(file, ordinal, cells): the records of header-less CSV files, of any number of cells, trimmed. A file is read in splits, whose lines one task then puts together in their order, as a quoted cell may hold line breaks; that task holds a batch of records and no more. What isn't UTF-8 becomes replacement characters, and a mark at the beginning goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        lines = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for name, own in groupby(lines, key=lambda x: x[0]):
            said = (line.as_py().decode("utf-8", "replace") + "\n" for _, line in own)
            first = next(said).removeprefix("\ufeff")
            rows = enumerate(csv.reader(chain([first], said)), 1)
            while part := list(islice(rows, batch)):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([k for k, _ in part], pa.int64()), pa.array([[c.strip() for c in cells] for _, cells in part], pa.list_(pa.string()))], ["file", "ordinal", "cells"])

    paths = list(path) if not isinstance(path, str) else path
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "start", "place").select("file", "line")
    return ordered.mapInArrow(run, "file string, ordinal long, cells array<string>")


def positional_csv(spark: SparkSession, path: str | Sequence[str], source: str = "exais_sms") -> DataFrame:
    """Records without a header: the label is the first cell that is one, the text the cells from the eighth on, or else the cell with most letters, the time the first cell with a slash and a colon."""
    df = records(spark, path)
    label = F.get(F.filter("cells", lambda c: F.lower(c).isin("spam", "ham")), F.lit(0))
    letters = lambda c: F.length(F.regexp_replace(c, r"(?U)[^\p{IsAlphabetic}]", ""))
    rest = F.array_join(F.filter(F.slice("cells", F.lit(8), F.greatest(F.size("cells") - 7, F.lit(0))), lambda c: c != ""), " ")
    longest = F.array_max(F.transform("cells", lambda c, i: F.struct(letters(c).alias("n"), (-i).alias("i"), c.alias("c"))))["c"]
    text = F.when(F.size("cells") > 7, rest).otherwise(longest)
    time = F.get(F.filter("cells", lambda c: c.contains("/") & c.contains(":")), F.lit(0))
    return raw(df, source, text=clean_str(text), canonical_label=map_label_basic(label), original_label=F.lower(label), timestamp_original=time, language_hint=F.lit("en")).filter(F.col("canonical_label").isNotNull())


def binary_csv(spark: SparkSession, path: str, source: str = "malicious_benign_sms_mms") -> DataFrame:
    df = with_ordinal(read_csv(spark, path)).select("file", "ordinal", "message", "label", "ai_generated")
    label, ai = pick(df, "label"), pick(df, "ai_generated")
    canonical = map_binary_label(label, "spam")
    flag = F.when(F.lower(ai).isin("1", "true"), 1).otherwise(0)
    original = F.concat(F.lit("label="), label, F.lit(";ai_generated="), F.coalesce(ai, F.lit("None")))
    rule = F.concat(F.lit("label=="), label, F.lit("->"), canonical)
    return raw(df, source, text=pick(df, "message"), canonical_label=canonical, original_label=original, label_mapping_rule=rule, language_hint=F.lit("en"), is_ai_generated=flag).filter(F.col("canonical_label").isNotNull())


def typed_csv(spark: SparkSession, path: str, source: str = "smishing_4c") -> DataFrame:
    df = with_ordinal(read_csv(spark, path))
    features = [F.concat(F.lit(f"{c}="), F.coalesce(pick(df, c), F.lit(""))) for c in ("SLANG", "COMPANY", "Length_value", "Num_writing_errors", "Phone", "URL")]
    original = F.concat(F.coalesce(pick(df, "TYPE"), F.lit("unknown")), F.lit(" ["), F.concat_ws(";", *features), F.lit("]"))
    return raw(df, source, text=pick(df, "TEXT-ENG"), canonical_label=F.lit("smishing"), original_label=original, label_mapping_rule=F.lit("implicit_smishing"), language_hint=F.lit("en"))


def classed_csv(spark: SparkSession, path: str, source: str = "mimics_3500") -> DataFrame:
    df = with_ordinal(read_csv(spark, path, encoding="ISO-8859-1"))
    named = [F.concat(F.lit(f"{k}="), F.coalesce(pick(df, c), F.lit("unknown"))) for k, c in (("7class", "7_CLASSES"), ("13class", "13_CLASSES"), ("dataset", "DATASET"))]
    return raw(df, source, text=pick(df, "TEXT"), canonical_label=F.lit("smishing"), original_label=F.concat_ws(";", *named), language_hint=F.lit("en"))


def report_lines(lines: DataFrame, source: str, address: str) -> DataFrame:
    """Reports in JSON lines (column `value`), with community votes: text, canonical_label, timestamp_original, source, source_id, source_url, original_label, upvotes, downvotes. Blank and broken lines are left out."""
    smish = "struct<messageContent:string,rawText:string,timeSubmitted:string,timeReceived:string,messageID:string,url:string,upvotes:string,downvotes:string>"
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", f"message_id string, raw struct<smish:{smish}>, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j")).filter("j._bad is null").select("j.*")
    s = lambda n: F.col(f"raw.smish.{n}")
    up, down = (F.coalesce(s(n).try_cast("int"), F.lit(0)) for n in ("upvotes", "downvotes"))
    blank = lambda c: F.nullif(c, F.lit(""))
    said = F.when(up > 0, "smishing (community verified)").when(down > 0, "unlabeled (community rejected/downvoted)").otherwise("unlabeled (0 votes)")
    return parsed.select(
        clean_str(F.coalesce(blank(s("messageContent")), s("rawText"))).alias("text"),
        F.lit("").alias("canonical_label"),
        F.coalesce(iso_from_epoch_ms(F.coalesce(blank(s("timeSubmitted")), s("timeReceived"))), F.lit("")).alias("timestamp_original"),
        F.lit(source).alias("source"),
        F.coalesce(clean_str(F.coalesce(blank(s("messageID")), F.col("message_id"))), F.lit("")).alias("source_id"),
        F.coalesce(clean_str(s("url")), F.lit(address)).alias("source_url"),
        said.alias("original_label"),
        up.cast("string").alias("upvotes"),
        down.cast("string").alias("downvotes"),
    ).filter(F.col("text").isNotNull())


#: Readers by source.
LOADERS: Mapping[str, Callable[[SparkSession, str], DataFrame]] = {
    "mishra_soni_2022": lambda s, p: labeled_csv(s, p, "mishra_soni_2022", ("LABEL", "label"), ("TEXT", "text"), "en"),
    "mishra_extended": lambda s, p: labeled_csv(s, p, "mishra_extended", ("LABEL", "label"), ("TEXT", "text"), "en"),
    "hosseinpour_2025": priority_csv,
    "kaggle_spam_ham": lambda s, p: labeled_csv(s, p, "kaggle_spam_ham", ("target",), ("text",)),
    "kaggle_phishing": phishing_csv,
    "agarwal_2025": translated_csv,
    "uci_sms_spam": lambda s, p: labeled_csv(s, p, "uci_sms_spam", ("label",), ("text",), "en", sep="\t", header=False, names=("label", "text")),
    "nus_sms": nested_json,
    "spanish_spam_ham": lambda s, p: labeled_csv(s, p, "spanish_spam_ham", ("tipo",), ("mensaje",), "es"),
    "exais_sms": positional_csv,
    "malicious_benign_sms_mms": binary_csv,
    "smishing_4c": typed_csv,
    "mimics_3500": classed_csv,
}

# ---- fixed values ----
#: Where each source lies below a folder of raw files.
PLACES: Mapping[str, Sequence[str]] = {
    "mishra_soni_2022": ("mishra_soni_20_06_2022.csv",),
    "mishra_extended": ("mishra_extended_10191.csv",),
    "hosseinpour_2025": ("hosseinpour_2025_combined.csv",),
    "kaggle_spam_ham": ("kaggle_unknown_combined_spam_ham.csv",),
    "kaggle_phishing": ("kaggle_unknown_phishing_categories.csv",),
    "agarwal_2025": ("agarwal_2025_fishing_smishing.csv",),
    "uci_sms_spam": ("almeida_2011_uci_sms_spam/SMSSpamCollection",),
    "nus_sms": ("nus_2015_sms_corpus_en.json",),
    "spanish_spam_ham": ("spanish_spam_ham/train.csv", "spanish_spam_ham/test.csv"),
    "exais_sms": ("onashoga_2015_exais_sms_spam/USER *.csv",),
    "malicious_benign_sms_mms": ("malicious_benign_sms_mms/dataset_v3_undersampled_stratified_full.csv",),
    "smishing_4c": ("smishing_4C.csv",),
    "mimics_3500": ("mimics_3500_v1.csv",),
}
# ---- end of fixed values ----


def paths_below(folder: str) -> dict[str, list[str]]:
    """The paths of all sources below a folder of raw files."""
    return {name: [f"{folder.rstrip('/')}/{p}" for p in places] for name, places in PLACES.items()}


def read_sources(spark: SparkSession, paths: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """All sources as one table, in the order of `catalog.RECORD_ORDER`; a path that finds nothing is left out."""
    out = spark.createDataFrame([], RAW)
    for name in sorted(paths, key=lambda n: RANK.get(n, len(RANK))):
        each = [paths[name]] if isinstance(paths[name], str) else list(paths[name])
        for k, path in enumerate(each):
            if exists(spark, path):
                out = out.unionByName(LOADERS[name](spark, path).withColumn("part", F.lit(k)))
    return out
