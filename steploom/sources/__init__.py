"""Readers and writers."""

from steploom.sources.tables import read_table

__all__ = ["read_table"]
