"""Operators for preparing training data: formatting, archives, deduplication, scoring, filters."""
