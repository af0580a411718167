"""Quality rules: statistics of whole texts, and an ordered list of threshold rules learned from labels.

The list is learned by sequential covering. A rule grows by the threshold condition of greatest information gain on
two thirds of the labelled sample, loses the conditions that don't help on the other third, and is kept if it is
precise there; the documents it covers leave, and the next rule grows on the rest. Counts come from one aggregation
a step over binned statistics, at most features x thresholds x 2 rows. The list becomes one conditional expression.
Everything on documents is made of built-in functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut

SYMBOLS = "#*$%&|<>"
#: Labelled rows, least by hash, from which rules are learned.
SAMPLE_ROWS = 6_000
THRESHOLDS, RULES, CONDITIONS = 24, 8, 3
#: Least precision of a rule where it was not grown, and least rejected documents it covers in the whole sample.
PRECISION, COVER = 0.9, 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the rules may use, by name: numerator, denominator.
RATIOS = {
    "symbol_rate": ("n_symbols", "n_words"),
    "bang_rate": ("n_bangs", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df with the BASE counts, n_upper, n_bangs, n_lines and the RATIOS of its texts, each name behind prefix.

    Words are told apart in threes by 64-bit hashes: in a text of 20,000 words two different threes meet in one
    with a chance of 1 in 10 to the 11. A null text has no words, and every count 0.
    """
    p = prefix
    col = lambda name: F.col(p + name)
    keep = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias(p + "words"),
        lines.alias(p + "lines"),
        (F.length(text) - _count(text, r"[\x20\x09-\x0D]")).alias(p + "word_chars"),
        _count(text, f"[{SYMBOLS}]").alias(p + "n_symbols"),
        _count(text, "[A-Z]").alias(p + "n_upper"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias(p + "n_bangs"),
    )
    counts = [p + c for c in ("word_chars", "n_symbols", "n_upper", "n_bangs")]
    # each word is hashed once, and threes are hashes of hashes
    df = df.select(*keep, *counts, col("words"), col("lines"), F.transform(col("words"), lambda w: F.xxhash64(w)).alias(p + "hashes"))
    threes = F.transform(col("hashes"), lambda h, i: F.xxhash64(h, F.get(col("hashes"), i + 1), F.get(col("hashes"), i + 2)))
    df = df.select(
        *keep,
        *counts,
        F.size(col("words")).cast("long").alias(p + "n_words"),
        F.size(col("lines")).cast("long").alias(p + "n_lines"),
        (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long").alias(p + "n_dup_lines"),
        F.slice(threes, F.lit(1), F.greatest(F.size(col("words")) - 2, F.lit(0))).alias(p + "threes"),
    )
    counts += [p + c for c in ("n_words", "n_lines", "n_dup_lines")]
    # most texts repeat no three words: only the others are sorted
    repeats = F.size(F.array_distinct(col("threes"))) < F.size(col("threes"))
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    ordered = F.when(repeats, F.sort_array(F.transform(col("threes"), lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).otherwise(none)
    df = df.select(*keep, *counts, ordered.alias(p + "ordered"))
    o = col("ordered")
    same = F.filter(o, lambda x, i: (x["h"] == F.get(o, i - 1)["h"]) | (x["h"] == F.get(o, i + 1)["h"]))
    df = df.select(*keep, *counts, F.sort_array(F.transform(same, lambda x: x["at"])).alias(p + "starts"))
    s = col("starts")
    # each window covers three words, less those of the window before it
    fresh = F.transform(s, lambda at, i: F.coalesce(F.least(F.lit(3), at - F.get(s, i - 1)), F.lit(3)))
    df = df.select(*keep, *counts, F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x).alias(p + "n_repeat_words"))
    counts.append(p + "n_repeat_words")
    ratios = [F.when(col(d) > 0, col(n) / col(d)).otherwise(0.0).alias(p + name) for name, (n, d) in RATIOS.items()]
    # a filter above would be moved below these steps and repeat them; it can't pass a column like this one, if it uses it
    return df.select(*keep, *counts, *ratios, F.spark_partition_id().alias(p + "part"))


def settled(prefix: str = "") -> Column:
    """Always true; in a filter, it keeps the filter above the statistics."""
    return F.col(prefix + "part") >= 0


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


@dataclass
class Rule:
    """Rejects where every condition (ratio, at_least, threshold) holds; otherwise below the threshold."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.conditions:
            c = F.col(prefix + name)
            out = out & ((c >= threshold) if at_least else (c < threshold))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {t:.6g}" for n, up, t in self.conditions)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True to keep: the first rule that holds rejects, and what none covers stays."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(prefix), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and label of at most `rows` labelled documents, those with the least hash of their id. Labels that differ for one document count as 0; null ids and labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("y")).dropna()
    chosen = known.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    # at most `rows` ids are sent to every task
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    stats = with_statistics(texts, "text").filter(settled() & ~base_failed())
    return cut(stats.select((F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0).alias("grow"), *RATIOS))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(sample: DataFrame) -> list[Rule]:
    """The ordered rules; none where the sample has no rejected or no accepted document."""
    names = list(RATIOS)
    probs = [(k + 0.5) / THRESHOLDS for k in range(THRESHOLDS)]
    at = sample.agg(*[F.percentile_approx(F.col(n), probs, 2000).alias(n) for n in names], *[F.percentile_approx(F.when(F.col("bad"), F.col(n)), probs, 2000).alias(f"bad_{n}") for n in names]).first()
    cuts = {n: sorted({*(at[n] or []), *(at[f"bad_{n}"] or [])}) for n in names}
    # the number of thresholds at or below the value
    bins = F.array(*[sum((F.when(F.col(n) >= t, 1).otherwise(0) for t in cuts[n]), F.lit(0)) for n in names])
    rows = cut(sample.select("bad", "grow", bins.alias("bins")))

    def holds(conditions: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for j, up, k in conditions:
            b = F.get("bins", F.lit(j))
            out = out & ((b > k) if up else (b <= k))
        return out

    rules: list[Rule] = []
    rest = F.lit(True)
    while len(rules) < RULES:
        grown: list[tuple[int, bool, int]] = []
        while len(grown) < CONDITIONS:
            counted = rows.filter(F.col("grow") & rest & holds(grown)).select("bad", F.posexplode("bins").alias("j", "b")).groupBy("j", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            by: dict[int, list] = {}
            for r in sorted(counted, key=lambda r: (r["j"], r["b"])):
                by.setdefault(r["j"], []).append((r["b"], r["p"], r["n"]))
            if not by:
                break
            p0, n0 = sum(p for _, p, _ in by[0]), sum(n for _, _, n in by[0])
            if not p0 or not n0:
                break
            options = []
            for j, hist in by.items():
                for k in range(len(cuts[names[j]])):
                    p, n = sum(x[1] for x in hist if x[0] > k), sum(x[2] for x in hist if x[0] > k)
                    options += [(_gain(p, n, p0, n0), j, True, k), (_gain(p0 - p, n0 - n, p0, n0), j, False, k)]
            best = max(options, key=lambda x: (x[0], -x[1], x[2], -x[3]))
            if best[0] <= 1e-9:
                break
            grown.append(best[1:])
        if not grown:
            break
        # prefixes of the conditions, on the third where they were not grown and on all
        measures = []
        for k in range(1, len(grown) + 1):
            for where, tag in ((~F.col("grow"), "t"), (F.lit(True), "a")):
                measures += [F.count_if(where & holds(grown[:k]) & F.col("bad")).alias(f"p{tag}{k}"), F.count_if(where & holds(grown[:k]) & ~F.col("bad")).alias(f"n{tag}{k}")]
        m = rows.filter(rest).agg(*measures).first()
        worth = lambda k: (m[f"pt{k}"] - m[f"nt{k}"]) / (m[f"pt{k}"] + m[f"nt{k}"]) if m[f"pt{k}"] + m[f"nt{k}"] else -1.0  # noqa: B023, E731
        k = max(range(1, len(grown) + 1), key=lambda k: (worth(k), -k))
        p, n = m[f"pa{k}"], m[f"na{k}"]
        if worth(k) < 2 * PRECISION - 1 or p < COVER or p < PRECISION * (p + n):
            break
        rules.append(Rule([(names[j], up, float(cuts[names[j]][c])) for j, up, c in grown[:k]]))
        rest = rest & ~holds(grown[:k])
    return rules


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the BASE counts, base_failed, kept.

    Null and empty texts have no words and fail the base rules; null ids stay; repeated rows stay rows of their own;
    an empty table gives no rows, and without labels the base rules alone decide. A very long text is split into its
    words in one task, some 60 bytes a word, and repeated threes are sorted: n log n in its words. Other columns are
    not looked at.
    """
    rules = learn(labelled_sample(docs, labels, sample_rows, id_col, text_col))
    stats = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `judge` keeps, all columns as they are.

    Null and empty texts go, as they fail the base rules; null ids stay; of repeated rows all stay or all go; an empty
    table gives no rows; columns may have any names. Long texts cost what they cost in `judge`.
    """
    rules = learn(labelled_sample(docs, labels, sample_rows, id_col, text_col))
    p = "_quality_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = f"_{p}"
    return with_statistics(docs, text_col, p).filter(settled(p) & ~base_failed(p) & verdict(rules, p)).select(*docs.columns)
