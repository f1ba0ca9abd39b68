"""As-of joins: for each row of a table, the nearest earlier or later event of one or more sources.

Rows and events are stacked, moved once by key, and sorted by time; a running value then carries the
last event forward (backward as-of) or, in descending order, the next event back (forward as-of). No row
is paired with more than one event, a key may have any number of rows and events, and several sources
share the one exchange. Rows that tie with an event see it or not by ``exact``.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

col = F.col


@dataclasses.dataclass
class Source:
    """Events to look up: ``values`` (new name -> column) of the nearest one by ``time``.

    ``prefer`` ranks events of one time: the one with the smallest value is taken, null last.
    Events without a time are never found.
    """

    events: DataFrame
    time: str
    values: dict[str, str]
    backward: bool = False
    exact: bool = True
    prefer: str | None = None


def asof_join(rows: DataFrame, key: str, time: str, *sources: Source) -> DataFrame:
    """``rows`` with the values of each source's nearest event (null where there is none).

    A row without a time finds nothing. All rows stay, repeated ones too.
    """
    names = [n for s in sources for n in s.values]
    clash = set(names) & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the rows already")
    held = F.struct(*[col(c) for c in rows.columns])
    nothing = [F.lit(None).cast(s.events.select(F.struct(*[col(c).alias(n) for n, c in s.values.items()]).alias("v")).schema["v"].dataType).alias(f"_v{i}")
               for i, s in enumerate(sources)]
    stacked = rows.select(col(key).alias("_k"), col(time).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast("int").alias("_r"), held.alias("_row"), *nothing)
    kind = stacked.schema["_row"].dataType
    for i, s in enumerate(sources):
        # where a tie counts, the event comes before the row (seen from its own direction)
        order = 0 if s.backward == s.exact else 2
        found = [F.struct(*[col(c).alias(n) for n, c in s.values.items()]).alias(f"_v{i}") if j == i else v for j, v in enumerate(nothing)]
        rank = col(s.prefer).cast("int") if s.prefer else F.lit(None).cast("int")
        stacked = stacked.unionByName(s.events.where(col(s.time).isNotNull()).select(
            col(key).alias("_k"), col(s.time).alias("_t"), F.lit(order).alias("_o"), rank.alias("_r"), F.lit(None).cast(kind).alias("_row"), *found))
    by_key = Window.partitionBy("_k")
    # the running value ends on the preferred event of a time: it comes last in the direction of the walk
    earlier = by_key.orderBy(col("_t").asc_nulls_first(), col("_o").asc(), col("_r").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    later = by_key.orderBy(col("_t").desc_nulls_first(), col("_o").desc(), col("_r").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    nearest = {f"_v{i}": F.last(f"_v{i}", ignorenulls=True).over(earlier if s.backward else later) for i, s in enumerate(sources)}
    out = stacked.withColumns(nearest).where(col("_row").isNotNull())
    known = col("_t").isNotNull() & col("_k").isNotNull()
    return out.select(*[col("_row")[c].alias(c) for c in rows.columns],
                      *[F.when(known, col(f"_v{i}")[n]).alias(n) for i, s in enumerate(sources) for n in s.values])
