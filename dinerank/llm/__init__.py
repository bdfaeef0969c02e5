"""Operators of a training-data pipeline: deduplication, search, classifiers,
packing, decontamination, secret scans, token counts and sharding.

Nothing outside this folder imports it.
"""
