"""Date bounds known at run time: the range of index dates, pushed into the event scans.

Each operator looks at events around a patient's index date. Whatever the patient, such an event lies
between the earliest index date less the look-back and the latest plus the look-ahead, so that range is a
plain predicate on the event table: it reaches the scan (partitions and row groups outside it are not
read) before any join. The per-patient rule still decides; without bounds the result is the same.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.dates import lit_date, plus_months

col = F.col


@dataclasses.dataclass(frozen=True)
class IndexBounds:
    """Earliest and latest index date of a cohort; both None: no patient, or not known."""

    first: dt.date | None = None
    last: dt.date | None = None

    def _at(self, day: dt.date, months: int, days: int) -> Column:
        return F.date_add(plus_months(lit_date(day), months), days)

    def since(self, event: str, months: int = 0, days: int = 0) -> Column:
        """``event`` is not before the earliest index date moved by months and days."""
        return F.lit(True) if self.first is None else col(event) >= self._at(self.first, months, days)

    def until(self, event: str, months: int = 0, days: int = 0) -> Column:
        """``event`` is not after the latest index date moved by months and days."""
        return F.lit(True) if self.last is None else col(event) <= self._at(self.last, months, days)

    def around(self, event: str, before: int = 0, after: int = 0, before_days: int = 0) -> Column:
        """``event`` lies within ``before`` months (and days) before and ``after`` months after some index date."""
        return self.since(event, -before, -before_days) & self.until(event, after)


UNBOUNDED = IndexBounds()


def index_bounds(keys: DataFrame, index: str = "diag_date") -> IndexBounds:
    """The range of index dates: one small aggregation of the (stored) cohort."""
    low, high = keys.agg(F.min(index), F.max(index)).first()
    return IndexBounds(low, high)


__all__ = ["IndexBounds", "UNBOUNDED", "index_bounds"]
