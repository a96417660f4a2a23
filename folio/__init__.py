"""Spark document analytics."""
