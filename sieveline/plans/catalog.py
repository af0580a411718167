"""Every registered query with its SQL, by name."""

from . import assembly, curation, evaluation  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
