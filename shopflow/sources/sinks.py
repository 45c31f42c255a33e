"""Sinks K-1..K-3 and K-5.

``single_file=True`` coalesces to one partition; use it only for results
already reduced to key cardinality (per day, per hour), never for per-user
or per-row outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopflow.functions.columns import field_report


def _one(df: DataFrame, single_file: bool) -> DataFrame:
    # Merging partitions keeps them in order, so a sorted frame stays sorted in its one file.
    return df.coalesce(1) if single_file else df


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K-1: JSON lines, overwrite."""
    _one(df, single_file).write.mode("overwrite").json(path)


def report_lines(df: DataFrame, fields=None) -> DataFrame:
    """K-2 rows: one ``value`` line ``field: value, field: value`` per row."""
    names = list(fields or df.columns)
    return df.select(field_report(*names).alias("value"))


def write_report(df: DataFrame, path: str, fields=None, single_file: bool = False) -> None:
    """K-2: ``field: value, ...`` text report, overwrite."""
    _one(report_lines(df, fields), single_file).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K-3: tab-separated ``key<TAB>value`` lines, no header, overwrite."""
    _one(df, single_file).write.mode("overwrite").option("sep", "\t").csv(path)


def preview(df: DataFrame, n: int = 20) -> None:
    """K-5: print the first ``n`` rows (console only)."""
    df.show(n, truncate=False)
