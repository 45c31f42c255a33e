"""The events rendered as a log with the faults that real logs have.

Each event's line gets one of ten variants by its id: cut fields, a blank
field of each kind, a user id that is no number, or none.  Every 50th event
is preceded by a header line, as in concatenated files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.schema import LAYOUT_5, LAYOUT_7

#: The variant (event_id modulo 10) that blanks each field; 0 cuts the line, 8 spoils the user id.
BLANK = {"user_id": 1, "item_id": 2, "item_category": 3, "time": 4, "date": 5, "hour": 6, "behavior_type": 7}
CUT, SPOILT = 0, 8


def messy_lines(actions: DataFrame, layout: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One ``value`` line per event, and the header lines, with the columns ``keep`` beside them."""
    fields = LAYOUT_7 if layout == 7 else LAYOUT_5
    variant = F.col("event_id") % 10
    day_hour = F.concat(F.col("date").cast("string"), F.lit(" "), F.lpad(F.col("hour").cast("string"), 2, "0"))

    def text(name: str):
        value = day_hour if name == "time" else F.col(name).cast("string")
        blank = F.lit("\t" if name == "user_id" else " ")
        return F.when(variant == BLANK[name], blank).otherwise(F.coalesce(value, F.lit("")))

    user = F.when(variant == SPOILT, F.lit("x1")).otherwise(text("user_id"))
    parts = [user, *[text(f) for f in fields[1:]]]
    line = F.when(variant == CUT, F.concat_ws(",", *parts[:3])).otherwise(F.concat_ws(",", *parts))
    header = F.lit(",".join(fields))
    lines = F.when(F.col("event_id") % 50 == 0, F.array(header, line)).otherwise(F.array(line))
    return actions.select(F.explode(lines).alias("value"), *keep)


def with_unknowns(actions: DataFrame) -> DataFrame:
    """The actions with every seventh event's user and every fifth event's item unknown."""
    return actions.withColumns(
        {
            "user_id": F.when(F.col("event_id") % 7 != 0, F.col("user_id")),
            "item_id": F.when(F.col("event_id") % 5 != 0, F.col("item_id")),
        }
    )
