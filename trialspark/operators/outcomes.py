"""Outcome template (O29-O38d), run once for all six outcomes.

The panel is stacked per outcome: ``(alf_pe, outcome_id, cal_time)``. All
per-(patient, outcome) quantities are window aggregates partitioned by
``(alf_pe, outcome_id)``; the rows of a patient are already co-located by the
``alf_pe`` join that built the panel, so no window adds a shuffle. Patient
facts that do not depend on the interval (O33-O35, O37, O38b) are computed on
the one-row-per-patient cohort, not on the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import codes
from trialspark.functions.dates import between, in_week, months_within, plus_months, plus_years
from trialspark.functions.predicates import specimen_indicator, specimen_rank
from trialspark.operators.asof import Source, asof_join
from trialspark.operators.bounds import UNBOUNDED, IndexBounds
from trialspark.operators.joins import KEY
from trialspark.params import StudyParams

col = F.col
OUT_KEY = [KEY, "outcome_id"]


def _per_outcome() -> Window:
    return Window.partitionBy(*OUT_KEY)


# ---------------------------------------------------------------- O29-O31
def outcome_flag(params: StudyParams) -> Column:
    """0 if no date or the date is after death / GP end / study end / index + 12m; else in-interval."""
    d = col("outcome_dt")
    late = ((d > col("dod")) | (d > col("gp_end_dt")) | (d > col("study_end"))
            | (d > plus_months("ruti_diag_dt", params.followup_months)))
    return (F.when(d.isNull(), 0).when(late, 0)
            .when(d.isNotNull() & in_week(d, "cal_dt", params.step_days), 1).otherwise(0))


def resolve_competing(df: DataFrame, params: StudyParams) -> DataFrame:
    """An outcome zeroes death/ltf/study_ended/diag_12months in its interval; then outcome vs new
    episode in one interval: a strictly earlier outcome wins (as written, D4), same day too (as documented).
    The order of the updates is kept (D19)."""
    hit = col("outcome") == 1
    df = df.withColumns({name: F.when(hit, 0).otherwise(col(name))
                         for name in ("death", "ltf", "study_ended", "diag_12months")})
    earlier = (col("outcome_dt") <= col("next_pabx_str")) if params.documented else \
        (col("outcome_dt") < col("next_pabx_str"))
    df = df.withColumn("new_pabx", F.when(hit & (col("new_pabx") == 1) & earlier, 0).otherwise(col("new_pabx")))
    return df.withColumn("outcome", F.when(hit & (col("new_pabx") == 1), 0).otherwise(col("outcome")))


def trim_after(df: DataFrame) -> DataFrame:
    """Drop intervals starting after the outcome date or after the next episode start (NULL keeps)."""
    keep_o = col("outcome_dt").isNull() | (col("cal_dt") <= col("outcome_dt"))
    keep_n = col("next_pabx_str").isNull() | (col("cal_dt") <= col("next_pabx_str"))
    return df.where(keep_o & keep_n)


# ---------------------------------------------------------------- O32
def inclusion_days(df: DataFrame, params: StudyParams) -> DataFrame:
    """``fup_obs`` = exit date (ltf, death, outcome, new episode, 12 months, study end) - index."""
    w = _per_outcome()
    one = {name: F.sum(name).over(w) == 1 for name in ("ltf", "death", "outcome", "new_pabx", "diag_12months")}
    exit_dt = (F.when(one["ltf"], col("gp_end_dt"))
               .when(one["death"], col("dod"))
               .when(one["outcome"], col("outcome_dt"))
               .when(one["new_pabx"], col("next_pabx_str"))
               .when(one["diag_12months"], plus_months("ruti_diag_dt", params.followup_months))
               .otherwise(col("study_end")))
    return df.withColumn("fup_obs", F.datediff(exit_dt, "ruti_diag_dt"))


# ---------------------------------------------------------------- O33
def closest_specimen(cohort: DataFrame, tests: DataFrame, params: StudyParams, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """``most_recent_urine`` from the latest specimen in [index - 1 year, index].

    Several specimens that day: the best ranked outcome wins (unlisted outcomes rank last). A
    backward as-of join replaces the row_number + UNION of the study.
    """
    near = bounds.around("spcm_collected_dt", before=12 * params.specimen_lookback_years)
    seen = tests.where(near).select(KEY, "spcm_collected_dt", specimen_rank().alias("_rank"))
    last = asof_join(cohort.select(KEY, "diag_date"), KEY, "diag_date",
                     Source(seen, "spcm_collected_dt", {"_day": "spcm_collected_dt", "_best": "_rank"}, backward=True, prefer="_rank"))
    return (last.where(col("_day") >= plus_years("diag_date", -params.specimen_lookback_years))
            .select(KEY, specimen_indicator(col("_best"), params).alias("most_recent_urine")))


# ---------------------------------------------------------------- O34
def exposure_type(cohort: DataFrame, exposure_starts: DataFrame, params: StudyParams, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """Type of the first episode starting in [index, index + 12 months).

    Rows of one type on that day are one; two types (a missing one counts as a type) fail the job,
    as the study's MERGE does. Other days are not judged.
    """
    kind = col("alt_abx_type")
    day = (exposure_starts.where(bounds.since("pabx_str") & bounds.until("pabx_str", params.followup_months))
           .groupBy(KEY, "pabx_str").agg(F.min(kind).alias("_low"), F.max(kind).alias("_high"), F.max(kind.isNull()).alias("_none")))
    first = (day.join(cohort.select(KEY, "diag_date"), KEY)
             .where(months_within("pabx_str", "diag_date", params.followup_months))
             .groupBy(KEY).agg(F.min(F.struct("pabx_str", "_low", "_high", "_none")).alias("_t")))
    several = (col("_t._low") != col("_t._high")) | (col("_t._none") & col("_t._low").isNotNull())
    error = F.raise_error(F.concat(F.lit("CardinalityError: exposure type: more than one type on the first day for "), col(KEY).cast("string")))
    return (first.where(F.coalesce(F.when(several, error.cast("boolean")), F.lit(True)))
            .select(KEY, col("_t._low").alias("pabx_type")))


# ---------------------------------------------------------------- O35
def _clamp(start: str, end: str, first: str, dur: str) -> dict[str, Column]:
    s_c = F.when(col(start) > col("min_end_dt"), F.lit(None)).otherwise(col(start))
    e_c = F.when(s_c.isNull(), F.lit(None)).otherwise(
        F.when(col(end) > col("min_end_dt"), col("min_end_dt")).otherwise(col(end)))
    return {start + "_c": s_c, end + "_c": e_c,
            dur: F.when(s_c.isNull(), F.lit(None)).otherwise(F.datediff(e_c, col(first)))}


def clamp_exposure(df: DataFrame) -> DataFrame:
    """Episode start after follow-up end -> NULL; end capped at follow-up end; durations.

    Adds ``pabx_str_c, pabx_end_c, pabx_duration`` and the ``_all`` counterparts; the
    unclamped values stay, because the interval flags were computed from them.
    """
    df = df.withColumns(_clamp("pabx_str", "pabx_end", "first_abx_dt", "pabx_duration"))
    return df.withColumns(_clamp("pabx_str_all", "pabx_end_all", "pabx_all_first_script", "pabx_duration_all"))


# ---------------------------------------------------------------- O36, O37
def death_after_outcome() -> Column:
    """Death between the outcome date and GP end (or study end)."""
    return F.when(between("dod", "outcome_dt", F.coalesce(col("gp_end_dt"), col("study_end"))), 1).otherwise(0)


def next_event_date(cohort: DataFrame, all_uti: DataFrame, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """First UTI after index (forward as-of)."""
    events = all_uti.where(bounds.since("event_str_dt", days=1)).select(KEY, "event_str_dt")
    after = asof_join(cohort.select(KEY, "diag_date"), KEY, "diag_date", Source(events, "event_str_dt", {"next_uti_dt": "event_str_dt"}, exact=False))
    return after.drop("diag_date").where(col("next_uti_dt").isNotNull())


def next_event_flag(params: StudyParams) -> Column:
    """The interval holding the next UTI."""
    return F.when(in_week("next_uti_dt", "cal_dt", params.step_days), 1).otherwise(0)


# ---------------------------------------------------------------- O38b
def started_before_index(cohort: DataFrame, exposure_starts: DataFrame) -> DataFrame:
    """Patients whose (clamped) episode has a component started before index <= episode start."""
    return (exposure_starts.select(KEY, col("pabx_str").alias("pabx_str_c"), "alt_str_dt")
            .join(cohort.select(KEY, "pabx_str_c", "diag_date"), [KEY, "pabx_str_c"])
            .where((col("alt_str_dt") < col("diag_date")) & (col("pabx_str_c") >= col("diag_date")))
            .select(KEY).distinct())


# ---------------------------------------------------------------- O38c
def exposure_blanked(start: str) -> Column:
    """Episode start after follow-up end, missing, or after the outcome -> exposure columns blanked."""
    s = col(start)
    return (s > col("min_end_dt")) | s.isNull() | (s > col("outcome_dt"))


FINAL_COLUMNS = [
    "alf", "outcome_id", "ruti_diagdate", "cal_time", "fup_obs", "birth_week", "ruti_age", "ethnic", "wimd", "bmi",
    "smoking", "alcohol", "frailty", "diab", "cancer", "ckd", "htn", "ihd", "cvd", "ccf", "ms", "mnd", "dementia",
    "pd", "severe_ment", "asthma", "copd", "immun_supp", "renal_stone", "urin_tract_abnorm", "amr_baseline",
    "most_recent_urine", "utis_gp_baseline", "utis_hosp_baseline", "gp_prescrib_rate", "pabx_start", "pabx_type",
    "dose", "dose_consistency", "time_to_pabx", "pabx_duration", "all_pabx", "all_pabx_duration", "gp_int_days",
    "outcome", "outcome_dt", "death", "death_dt", "fu_loss", "fu_loss_dt", "study_end", "diag_12months",
    "diag_12months_dt", "new_pabx_str", "new_pabx_str_dt", "death_after_outcome", "next_uti",
]


def assemble(df: DataFrame, params: StudyParams) -> DataFrame:
    """The outcome table (56 study columns + ``outcome_id``), fixed names and types."""
    blank = exposure_blanked("pabx_str_c")
    blank_all = exposure_blanked("pabx_str_all_c")
    null = F.lit(None)
    i = lambda name: col(name).cast("int")
    return df.select(
        col(KEY).alias("alf"), i("outcome_id").alias("outcome_id"), col("ruti_diag_dt").alias("ruti_diagdate"),
        i("cal_time").alias("cal_time"), i("fup_obs").alias("fup_obs"), col("wob").alias("birth_week"),
        i("agediag").alias("ruti_age"), i("ethnic").alias("ethnic"), i("wimd_2019_quintile").alias("wimd"),
        i("bmi_val").alias("bmi"), i("smok").alias("smoking"), i("alcohol_flg").alias("alcohol"),
        i("efi").alias("frailty"), i("diabetes").alias("diab"), i("cancer").alias("cancer"),
        i("renal_disease").alias("ckd"), i("hypertension").alias("htn"),
        # Positional mapping of the study
        i("cvd").alias("ihd"), i("cerebrov").alias("cvd"), i("heartfail").alias("ccf"),
        i("ms").alias("ms"), i("mnd").alias("mnd"), i("dementia").alias("dementia"), i("parkinsons").alias("pd"),
        i("smh").alias("severe_ment"), i("asthma").alias("asthma"), i("copd").alias("copd"),
        i("immun_supp").alias("immun_supp"), i("renal_stone").alias("renal_stone"),
        i("abn_renal").alias("urin_tract_abnorm"), i("amr_baseline").alias("amr_baseline"),
        i("most_recent_urine").alias("most_recent_urine"), i("gp_uti_pre").alias("utis_gp_baseline"),
        i("pedw_uti_pre").alias("utis_hosp_baseline"), col("gp_presc_rt").cast("double").alias("gp_prescrib_rate"),
        F.when(blank, 0).otherwise(col("pabx")).cast("int").alias("pabx_start"),
        F.when(blank, null).otherwise(col("pabx_type")).cast("string").alias("pabx_type"),
        F.when(blank, null).otherwise(col("dose")).cast("string").alias("dose"),
        F.when(blank, null).otherwise(col("dose_consistency")).cast("string").alias("dose_consistency"),
        F.when(blank, null).otherwise(col("days_to_pabx")).cast("int").alias("time_to_pabx"),
        F.when(blank, null).otherwise(col("pabx_duration")).cast("int").alias("pabx_duration"),
        F.when(blank_all, 0).otherwise(col("all_pabx")).cast("int").alias("all_pabx"),
        F.when(blank_all, null).otherwise(col("pabx_duration_all")).cast("int").alias("all_pabx_duration"),
        i("gp_int_days").alias("gp_int_days"),
        i("outcome").alias("outcome"), col("outcome_dt").alias("outcome_dt"),
        i("death").alias("death"), col("dod").alias("death_dt"),
        i("ltf").alias("fu_loss"), col("gp_end_dt").alias("fu_loss_dt"),
        i("study_ended").alias("study_end"), i("diag_12months").alias("diag_12months"),
        plus_months("ruti_diag_dt", params.followup_months).alias("diag_12months_dt"),
        i("new_pabx").alias("new_pabx_str"), col("next_pabx_str").alias("new_pabx_str_dt"),
        i("death_after_outcome").alias("death_after_outcome"), i("next_uti").alias("next_uti"),
    )
