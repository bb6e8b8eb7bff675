"""Operators of a training-data pipeline (dedup, search, decontamination,
scoring, tokenisation). Nothing else in ``quarry`` imports this package."""
