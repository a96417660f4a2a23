"""Operators over documents: extraction, chunks, index, query, diff, rendering."""
