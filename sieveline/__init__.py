"""Sieveline: curation and evaluation of message corpora as DataFrame, SQL and MLlib plans."""
