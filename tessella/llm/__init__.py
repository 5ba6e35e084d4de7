"""Operators for training data: splits, percentiles, sampling, overlaps, ranking and text."""
