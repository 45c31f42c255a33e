"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` as DOUBLE; NULL when ``den`` is 0 (no ANSI error)."""
    return F.try_divide(_col(num).cast("double"), _col(den))


def percent(num, den) -> Column:
    """``100 * num / den`` as DOUBLE; NULL when ``den`` is 0."""
    return F.try_divide(F.lit(100.0) * _col(num).cast("double"), _col(den))


def ratio_or_zero(num, den) -> Column:
    """``num / den`` as DOUBLE, 0.0 when ``den`` is not positive.

    The per-day ratios keep a day whose denominator is 0 with value 0.
    """
    return F.when(_col(den) > 0, _col(num).cast("double") / _col(den)).otherwise(F.lit(0.0))


def _bucket(col, bounds, value) -> Column:
    """CASE over the half-open intervals ``[1, b1), [b1, b2), ..., [bn, inf)``;
    ``value(lo, hi)`` gives the result for each (``hi`` is None for the last)."""
    c = _col(col)
    edges = [1, *bounds]
    expr = None
    for lo, hi in zip(edges, edges[1:]):
        cond, v = c < F.lit(hi), value(lo, hi)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    last = value(edges[-1], None)
    return last if expr is None else expr.otherwise(last)


def bucket_label(col, bounds) -> Column:
    """Label ``col`` with the half-open interval of ``bounds`` it falls in.

    ``bounds=(50, 100, 800)`` gives ``[1,50)``, ``[50,100)``, ``[100,800)``,
    ``[800,inf)``; values are counts, so the first interval starts at 1.
    """
    return _bucket(col, bounds, lambda lo, hi: F.lit(f"[{lo},{'inf' if hi is None else hi})"))


def bucket_low(col, bounds) -> Column:
    """Lower edge of the interval chosen by :func:`bucket_label`."""
    return _bucket(col, bounds, lambda lo, hi: F.lit(lo)).cast("int")


def field_report(*names: str) -> Column:
    """K-2 line format ``name: value, name: value``."""
    return F.concat_ws(
        ", ", *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names]
    )


# Fixed value: the white space that a blank field may hold (as Python's ``str.strip`` has it, in the Latin range).
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(col) -> Column:
    """A text without leading and trailing white space of any kind."""
    return F.btrim(_col(col), F.lit(WHITE_SPACE))
