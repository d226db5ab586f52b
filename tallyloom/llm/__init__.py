"""Operators of a training-data pipeline: scans, filters, joins, scores and packed output for text corpora."""
