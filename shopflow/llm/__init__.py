"""Operators of a training-data pipeline: deduplication, decontamination,
language identification, secret scans, mixing, token counts and vector search.

Nothing outside this package imports it.
"""
