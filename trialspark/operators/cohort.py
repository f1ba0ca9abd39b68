"""Cohort and baseline operators (O1-O15, O21, O22): one row per patient.

Each attribute operator takes a narrow ``keys`` frame (``alf_pe`` + the dates
it needs), joins one event source on ``alf_pe`` (range predicates stay join
residuals), and returns a per-patient aggregate ``(alf_pe, new columns...)``
built with partial aggregation. ``attach`` adds it to the cohort with a left
join. Aggregates are computed from a fixed key frame, never from the growing
cohort, so the plan grows linearly; no operator pairs a patient's rows with
each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import codes
from trialspark.functions.dates import between, is_true, lit_date, plus_days, plus_months, plus_years
from trialspark.functions.predicates import any_resistant, counts_as_contact
from trialspark.operators.asof import Source, asof_join
from trialspark.operators.bounds import UNBOUNDED, IndexBounds
from trialspark.operators.joins import KEY, checked_left_join, one_value
from trialspark.params import StudyParams

col = F.col


# ---------------------------------------------------------------- O1, O2
def eligible(cohort: DataFrame, params: StudyParams) -> DataFrame:
    """O1: deprivation known and no prophylaxis flag."""
    return cohort.where(col("wimd_2019_quintile").isNotNull() & (col("pabx") == 0))


def _exit_rules(params: StudyParams):
    diag12 = plus_months("diag_date", params.followup_months)
    max_age = plus_years("wob", params.max_age_years)
    # The source writes "wob+120" without a unit next to "wob + 120 YEARS"
    bare = max_age if params.documented else plus_days("wob", params.max_age_years)
    gp, d = col("gp_end_date"), col("dod")
    y0, y1 = params.study_years
    r12 = (diag12 < max_age) & (diag12 < gp) & ((bare < d) | d.isNull())
    rltf = ((gp < F.date_sub(d, 1)) | (F.year(gp).between(y0, y1) & d.isNull())) & (gp < max_age)
    rdied = (d <= F.date_add(gp, 1)) & (d <= max_age)
    rold = (max_age < gp) & ((bare < d) | d.isNull())
    return diag12, max_age, gp, d, r12, rltf, rdied, rold


def follow_up_exit(cohort: DataFrame, deaths: DataFrame, params: StudyParams) -> DataFrame:
    """O2: ``dod``, ``cohort_end_dt``, ``cohort_end_reason`` by the ordered rule list.

    A patient with two deaths fails the job."""
    end = lit_date(params.study_end)
    df = checked_left_join(cohort, deaths.select(KEY, F.to_date("death_dt").alias("dod")), KEY, "deaths")
    diag12, max_age, gp, d, r12, rltf, rdied, rold = _exit_rules(params)
    end_dt = (F.when(r12, diag12).when(rltf, gp).when(rdied, d).when(rold, max_age).otherwise(end))
    reason = (F.when(r12 & (diag12 <= end), codes.REASON_12M)
              .when(rltf & (gp <= end), codes.REASON_LTF)
              .when(rdied & (d <= end), codes.REASON_DIED)
              .when(rold & (max_age <= end), codes.REASON_LTF)
              .otherwise(codes.REASON_STUDY_END))
    return df.withColumns({"cohort_end_dt": end_dt, "cohort_end_reason": reason})


# ---------------------------------------------------------------- O3
def prior_exposure_condition(params: StudyParams) -> Column:
    """Episode ended less than 12 months before index, or index inside [first start, episode end]."""
    diag, end = col("diag_date"), col("alt_end_dt_comb")
    recent = (diag > end) & (diag < plus_months(end, params.prior_exposure_months))
    return recent | between(diag, "pabx_after_ruti", end)


def prior_exposure_keys(cohort: DataFrame, exposure_ends: DataFrame, params: StudyParams) -> DataFrame:
    """Patients with an episode that ended < 12 months before index or that spans the index date.

    Episode ends are reduced to one row per patient and day before the join, so a patient with
    very many episodes brings at most as many rows as there are days.
    """
    keys = cohort.select(KEY, "diag_date", "pabx_after_ruti")
    return (exposure_ends.select(KEY, "alt_end_dt_comb").distinct().join(keys, KEY)
            .where(prior_exposure_condition(params)).select(KEY).distinct())


def exclude_prior_exposure(cohort: DataFrame, exposure_ends: DataFrame, params: StudyParams) -> DataFrame:
    """O3: drop those patients (an anti join against at most one row per patient)."""
    return cohort.join(prior_exposure_keys(cohort, exposure_ends, params), KEY, "left_anti")


# ---------------------------------------------------------------- O4, O5, O6
def contact_days(keys: DataFrame, gp_events: DataFrame, params: StudyParams, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """``(alf_pe, gp_int_days)``: distinct qualifying event days in (index, index + 1 year].

    Patients without such days are absent; ``attach_counts`` turns them into 0.
    """
    # one row per patient and day: a hot patient is combined before the shuffle
    near = bounds.since("event_dt", days=1) & bounds.until("event_dt", 12 * params.contact_window_years)
    ev = gp_events.where(counts_as_contact(col("event_cd")) & near).select(KEY, "event_dt").distinct()
    return (ev.join(keys.select(KEY, "diag_date"), KEY)
            .where(between("event_dt", F.date_add("diag_date", 1),
                           plus_years("diag_date", params.contact_window_years)))
            .groupBy(KEY).agg(F.count("event_dt").cast("int").alias("gp_int_days")))


def fill_from(cohort: DataFrame, lookup: DataFrame, target: str, source: str) -> DataFrame:
    """Keep the patient's own value, else the lookup's; two lookup rows for a patient fail the job."""
    lk = lookup.select(KEY, col(source).alias("_fill"))
    return (checked_left_join(cohort, lk, KEY, f"lookup of {target}")
            .withColumn(target, F.coalesce(col(target), col("_fill"))).drop("_fill"))


def days_to_exposure(cohort: DataFrame) -> DataFrame:
    """O6."""
    return cohort.withColumn("days_to_pabx", F.datediff("pabx_after_ruti", "diag_date"))


# ---------------------------------------------------------------- O7, O12
def episode_bounds(exposure_starts: DataFrame, exposure_ends: DataFrame) -> DataFrame:
    """Per (patient, episode start): earliest component start, latest component end.

    Each side is aggregated before the join, so duplicate components never pair up.
    """
    s = exposure_starts.groupBy(KEY, "pabx_str").agg(F.min("alt_str_dt").alias("first_script"))
    e = exposure_ends.groupBy(KEY, "pabx_str").agg(F.max("alt_end_dt_comb").alias("last_end"))
    return s.join(e, [KEY, "pabx_str"])


def exposure_bounds(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(alf_pe, first_abx_dt, pabx_end)`` for each patient's exposure start ``pabx_str``.

    ``episode_bounds`` has one row per patient and start; other bounds with two fail the job."""
    b = bounds.select(KEY, "pabx_str", col("first_script").alias("first_abx_dt"), col("last_end").alias("pabx_end"))
    found = checked_left_join(keys.select(KEY, "pabx_str"), b, [KEY, "pabx_str"], "episode bounds")
    return found.where(col("first_abx_dt").isNotNull() | col("pabx_end").isNotNull()).drop("pabx_str")


def first_exposure_ever(keys: DataFrame, exposure_starts: DataFrame, bounds: DataFrame, near: IndexBounds = UNBOUNDED) -> DataFrame:
    """First episode start on or after index (any time), with its bounds; no row without bounds."""
    starts = exposure_starts.where(near.since("pabx_str")).select(KEY, "pabx_str")
    first = asof_join(keys.select(KEY, "diag_date"), KEY, "diag_date", Source(starts, "pabx_str", {"pabx_str_all": "pabx_str"}))
    b = bounds.select(KEY, col("pabx_str").alias("pabx_str_all"),
                      col("first_script").alias("pabx_all_first_script"), col("last_end").alias("pabx_end_all"))
    return first.drop("diag_date").join(b, [KEY, "pabx_str_all"])


# ---------------------------------------------------------------- O8
def dose_at_start(keys: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Group-3 prescriptions on the exposure start day; >1 distinct kind -> 'Multi'."""
    rx = prescriptions.where(col("event_in_grp") == 3).select(
        KEY, col("event_dt").alias("pabx_str"), F.struct("antibx_category", "dose", "dose_consistency").alias("_kind"))
    per = (rx.join(keys.select(KEY, "pabx_str"), [KEY, "pabx_str"])
           .groupBy(KEY).agg(F.count_distinct("_kind").alias("_n"), F.min("_kind").alias("_one")))
    multi = col("_n") > 1
    out = per.select(
        KEY,
        F.when(multi, F.lit("Multi")).otherwise(col("_one.dose")).alias("dose"),
        F.when(multi, F.lit("Multi")).otherwise(col("_one.dose_consistency")).alias("dose_consistency"))
    return out


# ---------------------------------------------------------------- O10, O11
def next_episode_start(keys: DataFrame, exposure_starts: DataFrame) -> DataFrame:
    """``(alf_pe, next_pabx_str)``: first episode start after the current episode's end (forward as-of)."""
    starts = exposure_starts.select(KEY, "pabx_str")
    after = asof_join(keys.select(KEY, "pabx_end"), KEY, "pabx_end", Source(starts, "pabx_str", {"next_pabx_str": "pabx_str"}, exact=False))
    return after.drop("pabx_end").where(col("next_pabx_str").isNotNull())


def override_exit_reason(cohort: DataFrame, params: StudyParams) -> DataFrame:
    """A new episode before death, GP end, study end and index + 12 months -> 'NEW PABX'."""
    n, d = col("next_pabx_str"), col("dod")
    new = (((n < d) | (n.isNotNull() & d.isNull()))
           & (n < col("gp_end_date")) & (n < lit_date(params.study_end))
           & (n < plus_months("diag_date", params.followup_months)))
    return cohort.withColumn("cohort_end_reason",
                             F.when(new, F.lit(codes.REASON_NEW)).otherwise(col("cohort_end_reason")))


# ---------------------------------------------------------------- O13, O14
def practice_rate(keys: DataFrame, registration: DataFrame, rates: DataFrame) -> DataFrame:
    """Practice registered at index -> its prescribing rate as decimal(5,3), stored as double.

    Registrations that touch or overlap at index count once if their rates agree; different
    rates fail the job. Patients without a registration at index, or whose practices have no
    rate, are absent.
    """
    reg = registration.select(col(KEY).alias("_k"), "prac_cd_pe", "start_date", "end_date")
    idx = keys.select(KEY, "diag_date")
    cond = (col(KEY) == col("_k")) & between("diag_date", "start_date", "end_date")
    prac = idx.join(reg, cond).select(KEY, "prac_cd_pe").distinct()
    found = prac.join(rates.select("prac_cd_pe", "abx_presc_rt"), "prac_cd_pe").select(
        KEY, col("abx_presc_rt").cast("decimal(5,3)").cast("double").alias("gp_presc_rt"))
    return one_value(found, KEY, "gp_presc_rt", "prescribing rate of the practice at index")


def baseline_resistance(keys: DataFrame, tests: DataFrame, params: StudyParams, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """``(alf_pe, amr_baseline=1)`` for any resistant result in [index - 365 days, index]; others get 0."""
    near = bounds.around("spcm_collected_dt", before_days=params.resistance_lookback_days)
    return (tests.where(any_resistant(params.antibiotics) & near).select(KEY, "spcm_collected_dt").distinct()
            .join(keys.select(KEY, "diag_date"), KEY)
            .where(between("spcm_collected_dt", F.date_sub("diag_date", params.resistance_lookback_days),
                           "diag_date"))
            .groupBy(KEY).agg(F.lit(1).alias("amr_baseline")))


# ---------------------------------------------------------------- O15
def earliest_end(cohort: DataFrame, params: StudyParams) -> DataFrame:
    """``min_end_dt``. ``least`` skips NULL, so the far-future sentinels are not needed."""
    diag12 = plus_months("diag_date", params.followup_months)
    died_first = (col("dod") < diag12) & (col("cohort_end_reason") == codes.REASON_DIED)
    least = F.least(col("gp_end_date"), col("dod"), lit_date(params.study_end), col("next_pabx_str"), diag12)
    return cohort.withColumn("min_end_dt", F.when(died_first, col("dod")).otherwise(least))


# ---------------------------------------------------------------- O21, O22
def baseline_uti_counts_gp(keys: DataFrame, gp_uti: DataFrame, hosp_uti: DataFrame,
                           params: StudyParams, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """GP UTI episodes in [index - 1 year, index], not inside the patient's hospital UTIs.

    As written, a GP episode is dropped only if *every* hospital episode of the
    patient covers it (start + 1 day .. end, with SQL NULL rules). That is
    ``g >= max(start) + 1 AND g <= min(end)`` over the patient's hospital
    episodes, so one per-patient aggregate replaces the pairwise join.
    As documented (D9), it is dropped if *some* hospital episode covers it.
    """
    lo = plus_years("diag_date", -params.uti_lookback_years)
    near = bounds.around("event_str_dt", before=12 * params.uti_lookback_years)
    gp = (gp_uti.where((col("data_source") == codes.GP_SOURCE) & near)
          .select(KEY, "event_str_dt", "event_end_dt", "data_source").distinct())
    if params.documented:
        kept = _outside_hospital(gp, hosp_uti)
        return (kept.join(keys.select(KEY, "diag_date"), KEY).where(between("event_str_dt", lo, "diag_date"))
                .groupBy(KEY).agg(F.count(F.lit(1)).cast("int").alias("gp_uti_pre")))
    hs = hosp_uti.groupBy(KEY).agg(F.max("event_str_dt").alias("_max_s"), F.min("event_end_dt").alias("_min_e"),
                                   F.lit(1).alias("_has_h"))
    g = col("event_str_dt")
    covered = (col("_has_h").isNotNull()
               & (col("_max_s").isNull() | (g >= F.date_add("_max_s", 1)))
               & (col("_min_e").isNull() | (g <= col("_min_e"))))
    return (gp.join(keys.select(KEY, "diag_date"), KEY)
            .where(between("event_str_dt", lo, "diag_date"))
            .join(hs, KEY, "left")
            .where(~is_true(covered))
            .groupBy(KEY).agg(F.count_distinct(F.struct("event_str_dt", "event_end_dt", "data_source"))
                              .cast("int").alias("gp_uti_pre")))


def _outside_hospital(gp: DataFrame, hosp_uti: DataFrame) -> DataFrame:
    """GP episodes that no hospital episode covers (start + 1 day .. end): over the patient's
    episodes in order of start, the latest end of those that started before."""
    h = hosp_uti.select(KEY, "event_str_dt", "event_end_dt").distinct()
    none = F.lit(None).cast("date")
    both = (gp.select(KEY, "event_str_dt", "event_end_dt", "data_source", none.alias("_h"))
            .unionByName(h.select(KEY, "event_str_dt", none.alias("event_end_dt"), F.lit(None).cast("string").alias("data_source"),
                                  col("event_end_dt").alias("_h"))))
    before = Window.partitionBy(KEY).orderBy(F.unix_date("event_str_dt")).rangeBetween(Window.unboundedPreceding, -1)
    return (both.withColumn("_until", F.max("_h").over(before))
            .where(col("data_source").isNotNull() & (col("_until").isNull() | (col("_until") < col("event_str_dt"))))
            .drop("_h", "_until"))


def baseline_uti_counts_hosp(keys: DataFrame, hosp_uti: DataFrame, params: StudyParams,
                             bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """Distinct hospital UTI episodes starting or ending in [index - 1 year, index]."""
    lo = plus_years("diag_date", -params.uti_lookback_years)
    near = [bounds.around(c, before=12 * params.uti_lookback_years) for c in ("event_str_dt", "event_end_dt")]
    h = (hosp_uti.where((col("data_source") == codes.HOSPITAL_SOURCE) & (near[0] | near[1]))
         .select(KEY, "event_str_dt", "event_end_dt", "data_source").distinct())
    return (h.join(keys.select(KEY, "diag_date"), KEY)
            .where(between("event_end_dt", lo, "diag_date") | between("event_str_dt", lo, "diag_date"))
            .groupBy(KEY).agg(F.count_distinct(F.struct("event_str_dt", "event_end_dt", "data_source"))
                              .cast("int").alias("pedw_uti_pre")))


def attach(cohort: DataFrame, *aggregates: DataFrame, zero: tuple[str, ...] = ()) -> DataFrame:
    """Left-join per-patient aggregates onto the cohort; ``zero`` columns default to 0 when absent."""
    for agg in aggregates:
        cohort = cohort.join(agg, KEY, "left")
    if zero:
        cohort = cohort.withColumns({z: F.coalesce(col(z), F.lit(0)) for z in zero})
    return cohort
