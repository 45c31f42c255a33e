"""The ACTIONS data model: one row per user action.

Every operator in :mod:`shopflow.operators` takes a DataFrame with these
columns and returns a lazy DataFrame.  Sources (:mod:`shopflow.sources`)
produce it from parquet event tables or from delimited action-log text.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the action-log format: behaviour codes and their roles.
BROWSE = 1
FAVOURITE = 2
CART = 3
BUY = 4
DEFAULT_VALID_CODES = (1, 2, 3, 4)

# Column order of the two on-disk layouts (5 raw columns, or 7 with date/hour).
LAYOUT_5 = ("user_id", "item_id", "behavior_type", "item_category", "time")
LAYOUT_7 = LAYOUT_5 + ("date", "hour")

ACTIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), True),
        T.StructField("item_id", T.LongType(), True),
        T.StructField("behavior_type", T.IntegerType(), False),
        T.StructField("item_category", T.LongType(), True),
        T.StructField("time", T.TimestampNTZType(), True),
        T.StructField("date", T.DateType(), False),
        T.StructField("hour", T.IntegerType(), False),
    ]
)
ACTION_COLUMNS = tuple(f.name for f in ACTIONS.fields)

# Optional column that keeps the source's own behaviour value.  Filters on a
# behaviour role are written against it so they reach the parquet scan
# (a filter on the CASE-derived code is not pushed down).
NATIVE = "native_behavior"
_CODES_KEY = "behavior_codes"


def native_column(col: Column, codes: dict[int, tuple]) -> Column:
    """Alias ``col`` as the native behaviour column, recording the code map.

    ``codes`` maps a behaviour code to the native values that mean it.
    The map travels as column metadata, so operators need no extra argument.
    """
    meta = {_CODES_KEY: {str(k): list(v) for k, v in codes.items()}}
    return col.alias(NATIVE, metadata=meta)


def behavior_is(actions: DataFrame, code: int) -> Column:
    """Predicate "this action has behaviour ``code``".

    Uses the native column when the frame carries one (pushed to the scan),
    otherwise the integer code.  Both forms select the same rows.
    """
    if NATIVE in actions.columns:
        meta = actions.schema[NATIVE].metadata.get(_CODES_KEY)
        if meta and str(code) in meta:
            values = meta[str(code)]
            return F.col(NATIVE).isin(values) if len(values) > 1 else F.col(NATIVE) == values[0]
    return F.col("behavior_type") == F.lit(code)


def day_literal(day) -> Column:
    """A DATE literal from a ``date`` or ``'yyyy-MM-dd'`` string."""
    if isinstance(day, str):
        day = _dt.date.fromisoformat(day)
    return F.lit(day)


def on_day(actions: DataFrame, day) -> DataFrame:
    """F-1: the actions of one calendar day.

    Written on ``date``; for parquet sources ``date = to_date(time)`` and
    Catalyst turns the comparison into a ``time`` range that reaches the scan.
    """
    return actions.where(F.col("date") == day_literal(day))


# Optional multiplicity column: a frame pre-aggregated by some ACTIONS
# columns carries the number of actions each row stands for.  Operators count
# actions through the two helpers below, so they give the same results on the
# raw log and on such a table; distinct counts need no change.
WEIGHT = "n_actions"


def count_actions(frame: DataFrame) -> Column:
    """``count(*)`` of actions: ``sum(n_actions)`` on a pre-aggregated frame."""
    if WEIGHT in frame.columns:
        return F.coalesce(F.sum(WEIGHT), F.lit(0).cast("bigint"))
    return F.count(F.lit(1))


def count_actions_if(frame: DataFrame, cond: Column) -> Column:
    """``count_if(cond)`` of actions, weighted the same way."""
    if WEIGHT in frame.columns:
        return F.coalesce(F.sum(F.when(cond, F.col(WEIGHT))), F.lit(0).cast("bigint"))
    return F.count_if(cond)


def pre_aggregate(actions: DataFrame, keys=("date", "hour", "user_id", "behavior_type")) -> DataFrame:
    """One row per distinct ``keys`` with ``n_actions``; a map-side combined
    aggregate.  Every operator that needs only ``keys`` runs on it unchanged.

    A native behaviour column is kept beside ``behavior_type``, so a filter on
    a behaviour still reaches the scan; it splits the rows of a code only
    where several native values mean it."""
    if NATIVE in actions.columns and "behavior_type" in keys and NATIVE not in keys:
        keys = (*keys, NATIVE)
    return actions.groupBy(*keys).agg(count_actions(actions).alias(WEIGHT))
