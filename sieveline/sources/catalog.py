"""The sources in the order in which they are loaded, and the schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- fixed values ----
#: name, licence, address of each source, in the order in which they are loaded: of equal messages the first one's stays
SOURCES = (
    ("mishra_soni_2022", "research_use", "https://doi.org/10.17632/f45bkkt8pr.1"),
    ("mishra_extended", "research_use", "https://doi.org/10.17632/f45bkkt8pr.1"),
    ("hosseinpour_2025", "research_use", "https://doi.org/10.1145/3734477.3736147"),
    ("kaggle_spam_ham", "unknown", None),
    ("kaggle_phishing", "unknown", None),
    ("agarwal_2025", "research_use", "https://doi.org/10.1145/3730567.3764431"),
    ("uci_sms_spam", "research_use", "https://archive.ics.uci.edu/dataset/228/sms+spam+collection"),
    ("nus_sms", "research_use", "https://doi.org/10.1007/s10579-012-9197-9"),
    ("spanish_spam_ham", "unknown", None),
    ("exais_sms", "research_use", None),
    ("malicious_benign_sms_mms", "cc_by_nc_4_0", None),
    ("smishing_4c", "research_use", "https://www.kaggle.com/datasets/galactus007/sms-smishing-collection-data-set"),
    ("mimics_3500", "research_use", "https://data.mendeley.com/datasets/f45bkkt8pr/1"),
)
MASTER_COLUMNS = (
    "message_id", "canonical_label", "text_raw", "text_anonymized", "text", "reference", "source_id",
    "original_label", "label_mapping_rule", "timestamp_original", "license", "is_ai_generated", "language",
    "language_confidence", "obfuscation_tags", "anonymization_status", "llm_model", "prompt_version",
    "llm_annotation_date", "theme", "urgency_level", "whois_domain", "whois_tld", "whois_age_days",
    "whois_hidden", "whois_country",
)
# ---- end of fixed values ----

RANK = {name: k for k, (name, _, _) in enumerate(SOURCES)}
LICENSE = {name: licence for name, licence, _ in SOURCES}
ADDRESS = {name: address for name, _, address in SOURCES}

RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("text", "canonical_label", "timestamp_original", "source", "source_id", "source_url", "original_label", "label_mapping_rule", "license", "language_hint")]
    + [T.StructField("is_ai_generated", T.IntegerType()), T.StructField("source_rank", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType())]
)

#: The order of all records: source, place of the path among the source's paths, file by name, place in the file.
RECORD_ORDER = ("source_rank", "part", "file", "ordinal")


def sources(spark: SparkSession) -> DataFrame:
    """The catalog as a table: name, licence, address, rank."""
    return spark.createDataFrame([(n, c, a, RANK[n]) for n, c, a in SOURCES], "source string, license string, source_url string, source_rank int")
