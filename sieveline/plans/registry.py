"""How queries are registered, and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import HOMOGLYPHS
from ..sources.shared import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Documents with the label that our tables stand for: toxic is smishing, else low quality is spam, else ham.
LABELED = """labeled AS (SELECT d.*, CASE WHEN l.toxic = 1 THEN 'smishing' WHEN l.quality = 0 THEN 'spam' WHEN l.quality = 1 THEN 'ham' END AS canonical_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
#: The same with a prediction from marks in the text.
JUDGED = (
    LABELED
    + """, judged AS (SELECT *, canonical_label AS true_label,
  CASE WHEN contains(text, '@') OR contains(text, '=') THEN 'smishing' WHEN regexp_matches(text, '[*#|!]') THEN 'spam' ELSE 'ham' END AS predicted_label
  FROM labeled WHERE canonical_label IS NOT NULL)"""
)
#: Whether `clean` holds letters set apart by spaces, or by marks, and the text with each such run as one word.
SPACED_SQL = r"regexp_matches(clean, '\b([a-zA-Z]\s){3,}[a-zA-Z]\b')"
DOTTED_SQL = r"regexp_matches(clean, '\b([a-zA-Z][.\-_]){3,}[a-zA-Z]\b')"
_TIGHT = r"list_reduce(list_prepend(clean, regexp_extract_all(clean, '\b(?:[a-zA-Z]\s){3,}[a-zA-Z]\b')), lambda t, m: replace(t, m, replace(m, ' ', '')))"
REPAIRED = rf"list_reduce(list_prepend({_TIGHT}, regexp_extract_all({_TIGHT}, '\b(?:[a-zA-Z][.\-_]){{3,}}[a-zA-Z]\b')), lambda t, m: replace(t, m, regexp_replace(m, '[.\-_]', '', 'g')))"

#: Cleaned text and key of every document: the key is the repaired text's.
CLEANED = rf"""cleaned AS (SELECT *, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS clean FROM documents),
keyed AS (SELECT *, sha256(lower({REPAIRED})) AS dedupe_key FROM cleaned)"""

#: Whether each repair finds anything in `clean`, which has single spaces; the last for the common ranges of characters that NFKC changes.
OBFUSCATION_SQL = {
    "obf_zwsp": r"regexp_matches(clean, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{AD}]')",
    "obf_homoglyph": "regexp_matches(clean, '[" + "".join(HOMOGLYPHS) + "]')",
    "obf_spacing": SPACED_SQL,
    "obf_punctuation": DOTTED_SQL,
    "obf_newline": "false",
    "obf_font": r"regexp_matches(clean, '[\x{2100}-\x{214F}\x{2460}-\x{24FF}\x{3000}\x{FB00}-\x{FB06}\x{FF01}-\x{FFEF}\x{1D400}-\x{1D7FF}]')",
}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "smishing").when(F.col("quality") == 0, "spam").when(F.col("quality") == 1, "ham")
    return docs.join(labels, "doc_id", "left").withColumn("canonical_label", label).drop("toxic", "quality")


def predicted(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("=")), "smishing").when(F.rlike(text, F.lit("[*#|!]")), "spam").otherwise("ham")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeled(spark, sf_dir).filter(F.col("canonical_label").isNotNull())
    return rows.withColumns({"true_label": F.col("canonical_label"), "predicted_label": predicted(F.col("text"))})
