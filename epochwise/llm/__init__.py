"""Operators of a training-data pipeline: tokens, duplicates, packing, scores and rules."""
