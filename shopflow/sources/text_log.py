"""Delimited action-log text: scan, header removal, reject routing (S-1..S-3).

The log is comma-separated, one header line (possibly repeated, e.g. when
files are concatenated), no quoting, in one of two layouts:

* 5 columns: ``user_id,item_id,behavior_type,item_category,time`` with
  ``time`` as ``yyyy-MM-dd HH``; ``date`` and ``hour`` are derived from it;
* 7 columns: the same plus ``date`` (``yyyy-MM-dd``) and ``hour``.

Lines are read with ``spark.read.text`` and split with ``split``; every
validity test is an ordinary column expression, so the check stays in the
plan whatever columns a consumer later prunes (the CSV reader's
DROPMALFORMED skips its checks when columns are pruned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.functions.columns import strip
from shopflow.schema import ACTION_COLUMNS, ACTIONS, DEFAULT_VALID_CODES, LAYOUT_5, LAYOUT_7

REJECT_REASON = "reason"

# Fixed formats of the log: day "yyyy-MM-dd", time "yyyy-MM-dd HH" (hour may be unpadded).
# Shape is checked by pattern; the calendar check is the cast to DATE.
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2} \d{1,2}$"


def _header(layout: int) -> str:
    return ",".join(LAYOUT_7 if layout == 7 else LAYOUT_5)


# Nearly all fields are clean.  A field is read as it is first, and without the
# white space around it (a slow search for each of a set of signs) only where
# that gave nothing: the conditions below are evaluated in order.


def _number(field: str, kind: str) -> Column:
    """The field as a number; blank, missing or no number -> NULL."""
    return F.coalesce(F.col(field).try_cast(kind), strip(field).try_cast(kind))


def _shaped(field: str, shape: str, read) -> Column:
    """``read`` of the field if it has the shape, else NULL."""
    return F.when(F.col(field).rlike(shape), read(F.col(field))).when(strip(field).rlike(shape), read(strip(field)))


def _spoilt(field: str, value: Column) -> Column:
    """Something that is not blank was not understood."""
    return value.isNull() & F.coalesce(strip(field) != F.lit(""), F.lit(False))


def _behavior(field: str, codes: dict[int, tuple] | None) -> Column:
    """The behaviour code: the field's number, or the code that ``codes`` lists its text under."""
    if codes is None:
        return _number(field, "int")
    expr = F.lit(None).cast("int")
    for code, texts in codes.items():
        expr = F.when(strip(field).isin(*[str(t) for t in texts]), F.lit(int(code))).otherwise(expr)
    return expr


def _first_reason(checks) -> Column:
    expr = None
    for name, bad in checks:
        expr = F.when(bad, F.lit(name)) if expr is None else expr.when(bad, F.lit(name))
    return expr  # NULL when every check passes


def parse_all(
    lines: DataFrame,
    layout: int = 7,
    valid_codes=DEFAULT_VALID_CODES,
    mode: str = "permissive",
    column: str = "value",
    codes: dict[int, tuple] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parse text lines into one frame: the ACTIONS columns, ``reason``
    (NULL for a good line) and the original ``line``.  Header lines vanish.

    A line is rejected, with the first failing reason, when it has the wrong
    number of fields, a non-blank non-integer id, a behaviour code that is
    missing or not in ``valid_codes``, or no valid date / hour.  A blank
    ``user_id`` is kept as NULL (it counts in PV, not in UV).
    ``mode='strict'`` makes the first rejected line fail the job.
    ``codes`` (P-4) reads logs with their own behaviour values: it maps each
    code to the texts that mean it, for instance ``{1: ("pv", "view")}``.
    ``keep`` names further columns of ``lines`` that stay beside the line.
    """
    if layout not in (5, 7):
        raise ValueError("layout must be 5 or 7")
    if mode not in ("permissive", "strict"):
        raise ValueError("mode must be 'permissive' or 'strict'")
    headers = [_header(5), _header(7)]
    body = lines.select(F.col(column).alias("line"), *keep)

    # Staged projections: each field is split and cast once and then
    # referenced by name, which keeps the generated code small.
    split = body.select("line", *keep, F.split("line", ",", -1).alias("parts"))
    parts = F.col("parts")
    raw = split.select(
        "line",
        *keep,
        F.size(parts).alias("n_fields"),
        *[F.get(parts, F.lit(k)).alias(f"f{k}") for k in range(layout)],
    )
    typed = raw.select(
        "line",
        *keep,
        "n_fields",
        "f0", "f1", "f3", "f4",
        _number("f0", "bigint").alias("user_id"),
        _number("f1", "bigint").alias("item_id"),
        _behavior("f2", codes).alias("behavior_type"),
        _number("f3", "bigint").alias("item_category"),
        _shaped("f4", _TIME, lambda t: F.substring(t, 1, 10).try_cast("date")).alias("t_day"),
        _shaped("f4", _TIME, lambda t: F.substring(t, 12, 2).try_cast("int")).alias("t_hour"),
        *(
            [
                _shaped("f5", _DATE, lambda d: d.try_cast("date")).alias("d7"),
                _number("f6", "int").alias("h7"),
            ]
            if layout == 7
            else []
        ),
    )
    t_ok = F.coalesce(F.col("t_day").isNotNull() & F.col("t_hour").between(0, 23), F.lit(False))
    checked = typed.select("*", t_ok.alias("t_ok"))
    day, hr = F.col("t_day"), F.col("t_hour")
    time = F.when(F.col("t_ok"), day.cast("timestamp_ntz") + F.make_dt_interval(hours=hr))
    if layout == 7:
        date, hour = F.col("d7"), F.col("h7")
        time_bad = ~F.col("t_ok") & F.coalesce(strip("f4") != F.lit(""), F.lit(False))
    else:
        date, hour = F.when(F.col("t_ok"), day), F.when(F.col("t_ok"), hr)
        time_bad = ~F.col("t_ok")
    user_id, item_id, category = F.col("user_id"), F.col("item_id"), F.col("item_category")
    behavior = F.col("behavior_type")

    reason = _first_reason(
        [
            ("field_count", F.col("n_fields") != F.lit(layout)),
            ("user_id", _spoilt("f0", user_id)),
            ("item_id", _spoilt("f1", item_id)),
            ("behavior_type", ~F.coalesce(behavior.isin(list(valid_codes)), F.lit(False))),
            ("item_category", _spoilt("f3", category)),
            ("time", time_bad),
            ("date", date.isNull()),
            ("hour", ~F.coalesce(hour.between(0, 23), F.lit(False))),
        ]
    )
    # The finished record leaves through a one-row generator.  Filters on
    # ``reason`` and the header test then stay above it: pushed below, they
    # would inline the whole parse (or whatever produced ``line``) into the
    # filter and evaluate it again for every reference.
    record = F.struct(
        user_id.alias("user_id"),
        item_id.alias("item_id"),
        behavior.alias("behavior_type"),
        category.alias("item_category"),
        time.alias("time"),
        date.alias("date"),
        hour.alias("hour"),
        reason.alias(REJECT_REASON),
        F.col("line").alias("line"),
        *[F.col(c).alias(c) for c in keep],
        # A header has a non-numeric first field; the text test runs only then.
        # (A leading byte-order mark, as spreadsheet exports write, is ignored.)
        (user_id.isNull() & F.lower(strip(F.replace("line", F.lit("\ufeff"), F.lit("")))).isin(headers))
        .alias("is_header"),
    )
    parsed = checked.select(F.inline(F.array(record))).where(~F.col("is_header")).drop("is_header")
    if mode == "strict":
        fail = F.raise_error(F.concat(F.lit("rejected action-log line ("), F.col(REJECT_REASON),
                                      F.lit("): "), F.col("line")))
        parsed = parsed.where(F.when(F.col(REJECT_REASON).isNotNull(), fail).isNull())
    return parsed


def parse_lines(
    lines: DataFrame,
    layout: int = 7,
    valid_codes=DEFAULT_VALID_CODES,
    mode: str = "permissive",
    column: str = "value",
    codes: dict[int, tuple] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Parse text lines into (ACTIONS rows, rejected ``line, reason`` rows).

    See :func:`parse_all` for the rules.  Both frames come from the same
    plan; a caller that needs both should write :func:`parse_all` once.
    """
    parsed = parse_all(lines, layout, valid_codes, mode, column, codes)
    good = parsed.where(F.col(REJECT_REASON).isNull()).select(*ACTION_COLUMNS)
    rejects = parsed.where(F.col(REJECT_REASON).isNotNull()).select("line", REJECT_REASON)
    return good, rejects


def read_lines(spark: SparkSession, path: str, spread: int | None = None, with_file: bool = False) -> DataFrame:
    """Log lines from any Hadoop path (file, dir, glob).

    Plain text splits by block, so a large file is read in parallel.  A
    compressed file that cannot be split (gzip) is read by one task; with
    ``spread=N`` its lines are dealt round-robin to N partitions right after
    the read, so the parse and everything after it run in parallel even when
    one such file holds a large share of the log.  ``with_file`` adds
    ``file``, the path of the file that each line is from.
    """
    lines = spark.read.text(path)
    if with_file:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    return lines.repartition(spread) if spread else lines


def read_log(
    spark: SparkSession,
    path: str,
    layout: int = 7,
    valid_codes=DEFAULT_VALID_CODES,
    mode: str = "permissive",
    spread: int | None = None,
    codes: dict[int, tuple] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """S-1/S-5: scan and parse action-log text (see :func:`read_lines`).

    The header test is per line, not per split or per file.
    """
    return parse_lines(read_lines(spark, path, spread), layout, valid_codes, mode, codes=codes)


def for_table(parsed: DataFrame) -> DataFrame:
    """:func:`parse_all` rows as the parsed-log table holds them.

    Accepted rows don't keep their text.  Rejected ones keep text and reason,
    and no ``date``: one that was never checked makes no partition.
    """
    ok = F.col(REJECT_REASON).isNull()
    return parsed.withColumns({"accepted": ok, "line": F.when(~ok, F.col("line")), "date": F.when(ok, F.col("date"))})


def read_parsed_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(actions, rejects) from a parsed-log table written partitioned by
    ``accepted`` and ``date`` (see :func:`for_table`).

    The schema is given, not inferred, so partition values keep their types
    and ``accepted=true`` is a partition filter (only those folders are read).
    """
    schema = (
        T.StructType([f for f in ACTIONS.fields if f.name != "date"])
        .add("line", "string")
        .add(REJECT_REASON, "string")
        .add("accepted", "boolean")
        .add("date", "date")
    )
    table = spark.read.schema(schema).parquet(path)
    good = table.where(F.col("accepted")).select(*ACTION_COLUMNS)
    rejects = table.where(~F.col("accepted")).select("line", REJECT_REASON)
    return good, rejects


def rejected_counts(rejects: DataFrame) -> DataFrame:
    """Rejected lines per reason."""
    return rejects.groupBy(REJECT_REASON).agg(F.count(F.lit(1)).alias("n"))


def render_lines(actions: DataFrame, layout: int = 7) -> DataFrame:
    """ACTIONS rows back to log text (one ``value`` per line, no header).

    NULLs render as blank fields, so every line keeps ``layout`` fields.
    Formatting is done on the date and hour columns, not through a
    session-zone conversion of ``time``.
    """

    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    time_text = F.concat(F.col("date").cast("string"), F.lit(" "), F.lpad(F.col("hour").cast("string"), 2, "0"))
    fields = [s("user_id"), s("item_id"), s("behavior_type"), s("item_category"), time_text]
    if layout == 7:
        fields += [s("date"), s("hour")]
    return actions.select(F.concat_ws(",", *fields).alias("value"))
