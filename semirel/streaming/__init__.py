"""Incremental forms over unbounded tables."""
