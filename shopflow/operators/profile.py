"""Dataset profile (O-1), missing-value profile (P-5) and the profile of a raw log (P-5, P-6)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.functions.columns import ratio, strip
from shopflow.schema import ACTION_COLUMNS, LAYOUT_5, LAYOUT_7, count_actions, count_actions_if
from shopflow.sources.text_log import REJECT_REASON, parse_all


def dataset_profile(actions: DataFrame) -> DataFrame:
    """O-1: rows, distinct users, items and categories in one aggregate.

    Three distinct counts plan as one Expand plus a two-level hash aggregate;
    the map side dedupes each (value, group) before the shuffle, so what moves
    is bounded by the distinct values per task, not by the rows.
    """
    return actions.agg(
        count_actions(actions).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.count_distinct("item_category").alias("categories"),
    )


def _missing(df: DataFrame, name: str):
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return col.isNull() | (strip(col) == F.lit(""))
    return col.isNull()


def missing_profile(actions: DataFrame, columns=ACTION_COLUMNS) -> DataFrame:
    """P-5: per column, how many values are NULL (or blank, for text).

    One pass with one conditional count per column, then ``stack`` turns the
    single row into (column_name, n_missing) rows.
    """
    counts = actions.agg(
        *[count_actions_if(actions, _missing(actions, c)).alias(f"m{i}") for i, c in enumerate(columns)]
    )
    pairs = ", ".join(f"'{c}', m{i}" for i, c in enumerate(columns))
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, n_missing)")


def log_profile(lines: DataFrame, layout: int = 7, column: str = "value", by: tuple[str, ...] = (), **parsing) -> DataFrame:
    """P-5 and P-6 over the log itself, before anything is rejected.

    ``column_name, n_missing, n_rejected``: per field, the lines in which it is
    blank or absent, and the lines rejected because of it (``field_count`` for
    a wrong number of fields).  Header lines are not counted.  ``by`` names
    columns of ``lines`` to profile by, such as the ``file`` of each line.
    One scan, one aggregate.
    """
    parsed = parse_all(lines, layout=layout, column=column, keep=tuple(by), **parsing)
    parts = F.split("line", ",", -1)
    fields = LAYOUT_7 if layout == 7 else LAYOUT_5
    blank = {name: F.count_if(F.coalesce(strip(F.get(parts, F.lit(i))), F.lit("")) == "") for i, name in enumerate(fields)}
    reasons = ("field_count", *LAYOUT_7)
    row = parsed.groupBy(*by).agg(
        *[blank.get(name, F.lit(None).cast("bigint")).alias(f"m{i}") for i, name in enumerate(reasons)],
        *[F.count_if(F.col(REJECT_REASON) == name).alias(f"r{i}") for i, name in enumerate(reasons)],
    )
    triples = ", ".join(f"'{name}', m{i}, r{i}" for i, name in enumerate(reasons))
    return row.selectExpr(*by, f"stack({len(reasons)}, {triples}) AS (column_name, n_missing, n_rejected)")


def file_quality(lines: DataFrame, layout: int = 7, column: str = "value", file: str = "file", **parsing) -> DataFrame:
    """S-3 and P-5 per input file: which files of a log are damaged.

    ``file, n_lines, n_blank, n_rejected, reject_share, main_reason`` from
    lines with their file (``read_lines(..., with_file=True)``): the lines
    that are no headers, those with a blank or missing field, the rejected
    ones, and the most frequent reason for that (the one that is checked
    first, of equals; NULL if none is rejected).  A map-side combine sends one row per file and
    task, whatever the files' sizes.
    """
    parsed = parse_all(lines, layout=layout, column=column, keep=(file,), **parsing)
    parts = F.split("line", ",", -1)
    fields = LAYOUT_7 if layout == 7 else LAYOUT_5
    blank = [F.coalesce(strip(F.get(parts, F.lit(i))), F.lit("")) == "" for i in range(len(fields))]
    reasons = ("field_count", *LAYOUT_7)
    counts = parsed.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(reduce(or_, blank)).alias("n_blank"),
        F.count(REJECT_REASON).alias("n_rejected"),
        *[F.count_if(F.col(REJECT_REASON) == name).alias(f"r{i}") for i, name in enumerate(reasons)],
    )
    most = F.array_max(F.array(*[F.struct(F.col(f"r{i}").alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("reason")) for i, name in enumerate(reasons)]))
    return counts.select(
        file, "n_lines", "n_blank", "n_rejected", ratio("n_rejected", "n_lines").alias("reject_share"),
        F.when(F.col("n_rejected") > 0, most["reason"]).alias("main_reason"),
    )
