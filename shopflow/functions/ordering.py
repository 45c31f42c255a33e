"""Sorted results (T-1, T-2, T-5).

A sort is the last step before a result is shown or written: Spark
range-partitions the rows by the keys, so a large result is sorted in
parallel, and one reduced to key cardinality is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """T-1/T-2: rows in ascending order of ``keys`` (all columns, if none are named), NULL first."""
    return df.orderBy(*(keys or df.columns))


def by_frequency(df: DataFrame, count: str, *ties: str) -> DataFrame:
    """T-5: rows by descending ``count``; equal counts in ascending order of ``ties`` (the other columns)."""
    rest = ties or [c for c in df.columns if c != count]
    return df.orderBy(F.desc(count), *rest)
