"""Operators for training-data pipelines: cleaning, scoring, deduplicating, formatting and tokenising text tables."""
