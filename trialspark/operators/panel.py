"""Panel operators (O16-O20): one row per patient per interval.

The interval spine is ``posexplode(sequence(...))`` on the patient row: a
narrow Generate with no shuffle, and the position is ``cal_time`` for free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions import codes
from trialspark.functions.dates import between, in_week, lit_date, plus_months
from trialspark.operators.joins import KEY
from trialspark.params import StudyParams

col = F.col

# columns of the panel table (the reference's PRE2) carried from the patient row
PANEL_COLUMNS = [
    KEY, "ruti_diag_dt", "cal_dt", "first_abx_dt", "pabx_str", "pabx_end", "gp_end_dt", "study_end", "dod",
    "next_pabx_str", "cohort_end_reason", "min_end_dt", "pabx_str_all", "pabx_all_first_script", "pabx_end_all",
]
FLAG_COLUMNS = ["cal_time", "ltf", "death", "study_ended", "diag_12months", "pabx", "new_pabx", "all_pabx"]


#: Panel rows that one task makes or sorts.
PANEL_ROWS = 1 << 19


def partitions(spark, rows: int) -> int:
    """As many partitions as ``rows`` panel rows need, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PANEL_ROWS))


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` by ``key``, in as many partitions as ``rows`` panel rows need.

    A patient's row becomes hundreds of panel rows behind an exchange that is small itself; dealt by
    the size of that exchange, a few tasks would make and sort the whole panel.
    """
    return df.repartition(partitions(df.sparkSession, rows), key)


def most_intervals(params: StudyParams) -> int:
    """Intervals that a patient's follow-up can have."""
    return 31 * params.followup_months // params.step_days + 1


def interval_spine(start: Column, end: Column, step_days: int) -> Column:
    """Dates ``start, start+step, ...`` while ``date + (step-1) < end``; at least one.

    ``sequence(start, max(end, start), step)`` yields exactly those dates (the
    recursion stops once an interval reaches ``end``).
    """
    stop = F.coalesce(F.greatest(end, start), start)
    return F.sequence(start, stop, F.expr(f"INTERVAL {int(step_days)} DAYS"))


def on_exposure(start: str, end: str, step_days: int) -> Column:
    """Interval start inside [start, end], or the episode starts inside the interval."""
    s = col(start)
    return (F.when(s.isNull(), 0)
            .when(between("cal_dt", s, end), 1)
            .when(in_week(s, "cal_dt", step_days), 1)
            .otherwise(0))


def _exit_flag(reason: str, date: Column, step_days: int) -> Column:
    r = col("cohort_end_reason")
    return (F.when((r != reason) | r.isNull(), 0)
            .when((r == reason) & in_week(date, "cal_dt", step_days), 1)
            .otherwise(0))


def exit_flags(params: StudyParams) -> dict[str, Column]:
    """Each exit flag is set in the interval holding its reason's date."""
    step = params.step_days
    return {
        "death": _exit_flag(codes.REASON_DIED, col("dod"), step),
        "ltf": _exit_flag(codes.REASON_LTF, col("gp_end_dt"), step),
        "study_ended": _exit_flag(codes.REASON_STUDY_END, col("study_end"), step),
        "new_pabx": _exit_flag(codes.REASON_NEW, col("next_pabx_str"), step),
        "diag_12months": _exit_flag(codes.REASON_12M, plus_months("ruti_diag_dt", params.followup_months), step),
    }


def panel_base(cohort: DataFrame, params: StudyParams) -> DataFrame:
    """The patient row in panel names (the reference's VB_TAB_MIN_PRE), patients with an index date."""
    return cohort.where(col("diag_date").isNotNull()).select(
        KEY, col("diag_date").alias("ruti_diag_dt"), "first_abx_dt", "pabx_str", "pabx_end",
        col("gp_end_date").alias("gp_end_dt"), lit_date(params.study_end).alias("study_end"), "dod",
        "next_pabx_str", "cohort_end_reason", "min_end_dt", "pabx_str_all", "pabx_all_first_script", "pabx_end_all")


def interval_panel(cohort: DataFrame, params: StudyParams) -> DataFrame:
    """O16 + O17: explode the patient row into intervals with ``cal_dt`` and ``cal_time``."""
    base = panel_base(cohort, params)
    spine = interval_spine(col("ruti_diag_dt"), col("min_end_dt"), params.step_days)
    return base.select("*", F.posexplode(spine).alias("cal_time", "cal_dt"))


def panel(cohort: DataFrame, params: StudyParams) -> DataFrame:
    """O16-O19 composed (the reference's PRE2). Narrow transformations only."""
    p = interval_panel(cohort, params)
    step = params.step_days
    flags = {
        "pabx": on_exposure("pabx_str", "pabx_end", step),
        "all_pabx": on_exposure("pabx_str_all", "pabx_end_all", step),
        **exit_flags(params),
    }
    return p.withColumns(flags).select(*PANEL_COLUMNS, *FLAG_COLUMNS)
