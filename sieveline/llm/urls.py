"""URL filters: rules for hosts and paths, and a ratio of two character models for what no rule decides.

The models are variable-order: for accepted and for rejected URLs, the chance of a character after its context of
ORDER characters is interpolated with shorter contexts by Witten-Bell weights, down to single characters and a uniform
floor. Both are counted over all URLs that a rule decides, but a fifth, on which the threshold of the
length-normalised log-likelihood difference is calibrated. URLs are folded to a small alphabet first, which bounds the
models. Everything is made of built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: (host, path, verdict): a rule fits its host and all subdomains where the path begins with its own.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: At most this: the scores of all runs, 41 to the 4th of 12 bytes each, are then 34 MB, which every task can hold.
ORDER = 3
#: Characters after folding, by code from 1: letters, one digit, marks of URLs, one for all others. 0 is the edge: before the first character of a context, or the end as a last character.
FOLDED = "abcdefghijklmnopqrstuvwxyz0./-_?=&%#:+@~"
ALPHABET = len(FOLDED) + 1
BINS = 40


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, lower-cased; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def codes(url: Column, order: int = ORDER) -> Column:
    """The codes of the folded URL's characters, behind `order` edges and before one; null for null and empty URLs."""
    folded = F.regexp_replace(lower_ascii(F.regexp_replace(url, r"(?s)^.*?://", "")), "[0-9]", "0")
    folded = F.regexp_replace(folded, r"(?s)[^a-z0./\-_?=&%#:+@]", "~")
    edge = F.lit(0)
    each = F.transform(F.split(folded, ""), lambda c: F.when(c != "", F.position(c, F.lit(FOLDED))).otherwise(edge))
    each = F.slice(each, F.lit(1), F.length(folded))
    return F.when(F.length(folded) > 0, F.concat(F.array_repeat(edge, order), each, F.array(edge)))


def spell(run: int, order: int = ORDER) -> str:
    """The characters that a run stands for: ^ and $ are the edges."""
    digits = [run // ALPHABET**k % ALPHABET for k in range(order, -1, -1)]
    return "".join((f"^{FOLDED}" if k < order else f"${FOLDED}")[d] for k, d in enumerate(digits))


def _explode(rows: DataFrame, order: int, outer: bool = False) -> DataFrame:
    """One row for each character: `run` is the number that the codes of its context and its own are the digits of."""
    if order > ORDER:
        raise ValueError(f"contexts of over {ORDER} characters have more runs than every task can hold")
    rows = rows.withColumn("_codes", codes(F.col("url"), order))
    number = lambda i: sum((F.get("_codes", i - k) * ALPHABET**k for k in range(1, order + 1)), F.get("_codes", i))
    rows = rows.withColumn("_runs", F.transform(F.sequence(F.lit(order), F.array_size("_codes") - 1), number)).drop("_codes")
    # for a plain explode the optimizer would add a filter on the array and move it below these steps, inlined in each other
    rows = rows.withColumn("run", F.explode_outer("_runs")).drop("_runs")
    return rows if outer else rows.filter(F.col("run").isNotNull())


def run_scores(counted: DataFrame, seen: DataFrame, order: int = ORDER) -> DataFrame:
    """(run, delta): log-likelihood of each seen run's last character among accepted URLs less that among rejected ones. counted: (run, a, b), the two counts."""
    out = seen
    chance = {c: F.lit(1.0 / ALPHABET) for c in "ab"}
    for k in range(order + 1):
        # counts of the last k + 1 characters, and of their first k with any character after
        last = lambda run: F.pmod(run, F.lit(ALPHABET ** (k + 1)))  # noqa: B023, E731
        first = lambda t: F.floor(t / ALPHABET).cast("int")
        tail = counted.groupBy(last(F.col("run")).alias("t")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        if k:
            context = tail.groupBy(first(F.col("t")).alias("h")).agg(*[x for c in "ab" for x in (F.sum(c).alias(f"n{c}"), F.count_if(F.col(c) > 0).alias(f"t{c}"))])
            out = out.join(tail, last(out["run"]) == F.col("t"), "left").join(context, first(last(out["run"])) == F.col("h"), "left")
            got = {c: (F.coalesce(F.col(c), F.lit(0)), F.coalesce(F.col(f"n{c}"), F.lit(0)), F.coalesce(F.col(f"t{c}"), F.lit(0))) for c in "ab"}
        else:  # no more rows than the alphabet has characters
            singles = {r["t"]: r for r in tail.collect()}
            table = {c: [singles[t][c] if t in singles else 0 for t in range(ALPHABET)] for c in "ab"}
            got = {c: (F.get(F.array(*map(F.lit, x)), last(F.col("run"))), F.lit(sum(x)), F.lit(sum(n > 0 for n in x))) for c, x in table.items()}
        chance = {c: F.when(n + t > 0, (x + t * chance[c]) / (n + t)).otherwise(chance[c]) for c, (x, n, t) in got.items()}
        out = out.select("run", *[p.alias(f"p{c}") for c, p in chance.items()])
        chance = {c: F.col(f"p{c}") for c in "ab"}
    return out.select("run", (F.log("pa") - F.log("pb")).alias("delta"))


def _scored(rows: DataFrame, scores: DataFrame, keys: list[str], order: int) -> DataFrame:
    """rows by keys, with the mean delta over a URL's characters; 0 for a URL without any. All of a URL's characters are in one task, so that what is exchanged is a row a URL."""
    joined = _explode(rows, order, outer=True).join(F.broadcast(scores), "run", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.avg(F.coalesce("delta", F.when(F.col("run").isNotNull(), 0.0))), F.lit(0.0)).alias("score"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score.

    Null URLs and those without :// have an empty host and path, which no rule fits; a null or empty URL scores 0.
    Where rules decide no URL, or all alike, the threshold is 0: at or above it a URL is allowed. Null ids stay;
    repeated rows stay rows of their own; an empty table gives no rows. A very long URL is so many rows within one
    task, which keeps one sum for them. Other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    _, ruled = decide(host(F.col("url")), path(F.col("url")), rules)
    labelled = rows.withColumn("label", ruled).filter("label is not null").withColumn("held", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    learned = _explode(labelled.filter("not held").select("url", "label"), order)
    counted = cut(learned.groupBy("run").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b")))
    seen = _explode(rows.select("url"), order).select("run").distinct()
    scores = cut(run_scores(counted, seen, order))
    # a hash of the URL stands for it here: only counts by score leave
    held = _scored(labelled.filter("held").withColumn("rid", F.monotonically_increasing_id()), scores, ["rid", "label"], order)
    spot = F.greatest(F.least(F.floor(F.col("score") * BINS), F.lit(100 * BINS)), F.lit(-100 * BINS))
    hist = sorted((r["spot"], r["a"], r["b"]) for r in held.groupBy(spot.alias("spot")).agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b")).collect())
    threshold = calibrate(hist)
    scored = _scored(rows.withColumn("rid", F.monotonically_increasing_id()), scores, ["rid", "page_id", "url"], order)
    h, p = host(F.col("url")), path(F.col("url"))
    rule, said = decide(h, p, rules)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), F.coalesce(said, by_model).alias("verdict"), "score")


def calibrate(hist: Sequence[tuple[int, int, int]]) -> float:
    """The threshold with the greatest share of held-out accepted URLs at or above it plus rejected ones below it; of all that split alike, and of splits that are equally good, the one nearest 0. hist: (score * BINS, accepted, rejected), ascending."""
    a, b = sum(x[1] for x in hist), sum(x[2] for x in hist)
    if not a or not b:
        return 0.0
    best, above, below, low = (-1.0, 0.0, 0.0), a, 0, -100 * BINS
    for spot, x, y in [*hist, (100 * BINS, 0, 0)]:
        at = min(max(0, low), spot)  # any place above the bin before and not above this one
        best = max(best, (round(above / a + below / b, 9), -abs(at / BINS), at / BINS))
        above, below, low = above - x, below + y, spot + 1
    return best[2]
