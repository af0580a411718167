"""Timestamps of messages as ISO text: whole dates where one is shown, else the time alone, else nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Formats with a date, in order; a slash date is read month first, and day first where that fails.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd")
MONTH_FIRST = ("M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy h:mm a", "M/d/yyyy")
DAY_FIRST = ("d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy h:mm a", "d/M/yyyy")
NAMED = ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMM d, yyyy h:mm a", "MMM d, yyyy HH:mm", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy")


#: What stands for a run of a pattern's letter in the texts that it may parse; longer runs of y, M, d, h, H, m and s are of so many digits.
_SHAPES = {"yyyy": r"[+-]?[0-9]{4,}", "M": "[0-9]+", "d": "[0-9]+", "h": "[0-9]+", "MMM": "[^ ]+", "MMMM": "[^ ]+", "a": ".."}


def shape(pattern: str) -> str:
    """A regular expression that every text matches which a pattern of ours parses."""
    out = ""
    for quoted, run, _, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(.)", pattern):
        out += "".join(f"[{c.lower()}{c.upper()}]" for c in quoted) or (_SHAPES.get(run) or f"[0-9]{{{len(run)}}}" if run else re.escape(other))
    return rf"(?s)\A{out}\z"


def normalize_timestamp(c: Column, day_first: bool = False) -> Column:
    """`2014-12-31T10:08:00` or `10:08:00` or empty. Missing parts of a date are not made up.

    A text is parsed by the patterns of its own shape alone, as each that fails costs an exception.
    """
    s = F.trim(F.coalesce(c, F.lit("")))
    slash = DAY_FIRST + MONTH_FIRST if day_first else MONTH_FIRST + DAY_FIRST
    tried: dict[str, list[str]] = {}
    for f in (*FORMATS, *slash, *NAMED):
        tried.setdefault(shape(f), []).append(f)
    whole = F.coalesce(*[F.when(F.rlike(s, F.lit(k)), F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in own])) for k, own in tried.items()])
    said = F.regexp_extract(s, r"\b(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[aApP][mM])?)\b", 1)
    return F.coalesce(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), bound(said, _clock))


def _clock(said: Column) -> Column:
    """A time of day with seconds, hours from 0 to 23; as it is said where that is none."""
    clock = F.regexp_extract(said, r"^(\d{1,2}:\d{2}(?::\d{2})?)", 1)
    half = F.upper(F.regexp_extract(said, r"([aApP][mM])$", 1))
    hour = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int")
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    minute = F.split_part(clock, F.lit(":"), F.lit(2))
    second = F.coalesce(F.nullif(F.split_part(clock, F.lit(":"), F.lit(3)), F.lit("")), F.lit("00"))
    valid = (hour < 24) & (minute.try_cast("int") < 60) & (second.try_cast("int") < 60)
    time = F.when(valid, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":"), second)).otherwise(said)
    return F.when(said != "", time).otherwise("")
