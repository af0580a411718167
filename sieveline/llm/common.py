"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import clear, new_path, read_table, shared_dir

__all__ = ["clear", "cut", "free_name", "lower_ascii", "n_words", "new_path", "numbered", "read_table", "shared_dir", "utf8"]

#: Word characters of every contract: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: its lineage ends, and a lost executor costs only a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, name: str, *others: DataFrame) -> str:
    """A column name that df, and the others, do not have."""
    taken = {c.lower() for x in (df, *others) for c in x.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(parts: Column, n: int) -> Column:
    """A part number below n from a hash."""
    return F.pmod(parts, F.lit(n))
