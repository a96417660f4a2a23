"""Incremental runs over arriving snapshots."""
