"""Incremental processing of new files."""
