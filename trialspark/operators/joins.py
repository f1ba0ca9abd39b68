"""Join helpers: uniqueness checks and sources reduced to one value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "alf_pe"


class CardinalityError(ValueError):
    """A MERGE source / scalar sub-query had more than one row for a key."""


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """The offending keys (``key..., n``) of a source that must be unique on ``keys``.

    A plain ``groupBy`` with partial aggregation, so a hot key is combined map-side.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys, what: str = "source") -> DataFrame:
    """Raise :class:`CardinalityError` when ``df`` has a repeated key. Runs one small job."""
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise CardinalityError(f"{what}: more than one row per key, e.g. {[r.asDict() for r in bad]}")
    return df


def one_value(df: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """One row per key with its ``value`` (O9); a key with two different values fails the job.

    The check is part of the aggregation, so it costs no job of its own and
    can't be left out; equal values from several rows are one value.
    """
    low, high = F.min(value), F.max(value)
    error = F.raise_error(F.concat(F.lit(f"CardinalityError: {what}: different values for "), F.col(key).cast("string")))
    return df.groupBy(key).agg(F.when(low.eqNullSafe(high), low).otherwise(error).alias(value))


def checked_left_join(left: DataFrame, right: DataFrame, keys, what: str) -> DataFrame:
    """``left`` with the columns of its only match in ``right``; a second match fails the job.

    What a MERGE does: a source row that nothing matches may be repeated, a matched one may not, not
    even by an equal row. ``right`` is counted map-side on the join's own key, so the check adds no job
    and no exchange; it is a filter, so no later projection removes it. Null keys match nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_matches"), *[F.first(v).alias(f"_match_{v}") for v in values])
    key = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    error = F.raise_error(F.concat(F.lit(f"CardinalityError: {what}: more than one row for "), key))
    joined = left.join(one, keys, "left").where(F.coalesce(F.when(F.col("_matches") > 1, error.cast("boolean")), F.lit(True)))
    return joined.select(*left.columns, *[F.col(f"_match_{v}").alias(v) for v in values])
