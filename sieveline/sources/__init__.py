"""Readers that bring differently shaped corpora to one schema, and writers."""
