"""Relational operators: duplicates, samples and splits, metrics, enrichment, similarity, models."""
