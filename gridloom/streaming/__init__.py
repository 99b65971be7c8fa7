"""Grouping, import and validation of streams."""
