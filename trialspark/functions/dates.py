"""Column helpers for SQL date arithmetic and three-valued predicates.

Everything returns a ``Column`` built from ``pyspark.sql.functions`` so the
expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_date(d: dt.date | str) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def plus_days(d, n) -> Column:
    return F.date_add(c(d), n if isinstance(n, int) else c(n).cast("int"))


def plus_months(d, n: int) -> Column:
    """``d + n MONTHS``: the day is clamped to the end of a shorter month (29 Feb + 12 = 28 Feb)."""
    return F.add_months(c(d), n)


def plus_years(d, n: int) -> Column:
    return F.add_months(c(d), 12 * n)


def between(x, lo, hi) -> Column:
    """SQL ``x BETWEEN lo AND hi`` (closed, NULL if any side is NULL)."""
    x = c(x)
    return (x >= c(lo)) & (x <= c(hi))


def in_week(d, cal_dt, step_days: int = 7) -> Column:
    """``d BETWEEN cal_dt AND cal_dt + (step-1) days``."""
    return between(d, cal_dt, plus_days(cal_dt, step_days - 1))


def months_within(later, earlier, months: int) -> Column:
    """``0 <= MONTHS_BETWEEN(later, earlier) < months`` in the join-friendly half-open form."""
    return (c(later) >= c(earlier)) & (c(later) < plus_months(earlier, months))


def is_true(cond: Column) -> Column:
    """Collapse SQL UNKNOWN to FALSE (what WHERE and CASE WHEN do)."""
    return F.coalesce(cond, F.lit(False))


def any_of(conds) -> Column:
    return reduce(or_, list(conds))
