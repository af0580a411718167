"""Subsets of the master table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLASS_ORDER, ai_flag
from .sampling import hash_order, stratified_sample


@dataclass(frozen=True)
class Subset:
    """Every condition is optional, and all that are given hold; a length bound of 0 is none."""

    labels: Sequence[str] = ()
    languages: Sequence[str] = ()
    sources: Sequence[str] = ()
    exclude_ai: bool = False
    only_ai: bool = False
    min_length: int = 0
    max_length: int = 0
    sample: int = 0
    seed: int = 42
    columns: Sequence[str] = field(default_factory=tuple)

    def apply(self, df: DataFrame) -> DataFrame:
        for name, values in (("canonical_label", self.labels), ("language", self.languages), ("reference", self.sources)):
            if values:
                df = df.filter(F.col(name).isin(*values))
        if "is_ai_generated" in df.columns:
            df = df.withColumn("is_ai_generated", ai_flag(F.col("is_ai_generated")))
            if self.exclude_ai or self.only_ai:
                df = df.filter(F.col("is_ai_generated") == (0 if self.exclude_ai else 1))
        elif self.only_ai and not self.exclude_ai:
            df = df.filter(F.lit(False))
        length = F.length(F.coalesce("text", F.lit("")))
        if self.min_length:
            df = df.filter(length >= self.min_length)
        if self.max_length:
            df = df.filter(length <= self.max_length)
        if self.sample:
            df = stratified_sample(df, "canonical_label", self.sample, hash_order(self.seed, F.col("message_id")), CLASS_ORDER)
        kept = [c for c in self.columns if c in df.columns]
        return df.select(*kept) if self.columns else df
