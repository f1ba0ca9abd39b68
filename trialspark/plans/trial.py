"""The study as Spark plans: baseline cohort -> weekly panel -> six outcome tables.

Shuffle plan (``alf_pe`` is the only shuffle key of the whole chain):

* every event source is joined to the cohort once on ``alf_pe`` and reduced to
  one row per patient with partial aggregation;
* the patient rows are then exploded into (outcome x interval) rows with
  narrow ``Generate`` operators, and all per-(patient, outcome) logic is a
  window partitioned by ``(alf_pe, outcome_id)`` - satisfied by the existing
  ``alf_pe`` hash partitioning, so it adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import cohort as C
from trialspark.operators import events as E
from trialspark.operators import outcomes as O
from trialspark.operators import panel as P
from trialspark.operators.bounds import UNBOUNDED, IndexBounds, index_bounds
from trialspark.operators.joins import KEY, assert_unique
from trialspark.params import StudyParams
from trialspark.sources.catalog import SourceCatalog

col = F.col


# ---------------------------------------------------------------- baseline (the study's PRE table)
def exit_cohort(cat: SourceCatalog, params: StudyParams) -> DataFrame:
    """O1 + O2: eligible patients with death date and exit date/reason."""
    return C.follow_up_exit(C.eligible(cat.cohort, params), cat.deaths, params)


def check_sources(cat: SourceCatalog) -> None:
    """O38 before the run: one index date per patient (D14), one rate per practice. Raises ``CardinalityError``;
    each check is one aggregation job. Deaths, ethnicity, episode bounds and exposure types are checked where
    they are joined, whether this runs or not."""
    assert_unique(cat.cohort, KEY, "cohort (one index date per patient)")
    assert_unique(cat.practice_rate, "prac_cd_pe", "practice_rate")


def eligible_base(cat: SourceCatalog, params: StudyParams, exits: DataFrame | None = None) -> DataFrame:
    """The patients of the study, with what does not depend on their events after the index date.

    ``exits``: a stored :func:`exit_cohort`. The rule on earlier episodes reads it twice."""
    exits = exit_cohort(cat, params) if exits is None else exits
    base = C.exclude_prior_exposure(exits, cat.exposure_ends, params)
    base = C.fill_from(base, cat.ethnicity, "ethnic", "ethn_ec_ons_date_latest_code")
    return C.days_to_exposure(base).withColumn("pabx_str", col("pabx_after_ruti"))


def baseline_cohort(cat: SourceCatalog, params: StudyParams, materialise=None, check: bool = False,
                    base: DataFrame | None = None) -> DataFrame:
    """O1-O15, O21, O22 in the study's statement order. One row per patient.

    The tests are read once, so the row also holds what the outcome tables need of them
    (``events.LAB_FACTS``). ``materialise`` (e.g. ``session.cut``) is applied to the eligible base, which
    every per-patient aggregate reads; the range of its index dates then bounds the event scans. ``check`` runs :func:`check_sources` first.

    ``base``: a stored :func:`eligible_base`. The sources of ``cat`` then need no more than the events of its
    patients: every aggregate below joins them with the patients' keys.
    """
    if check:
        check_sources(cat)
    stored = base is not None
    if not stored:
        base = eligible_base(cat, params)
        if materialise is not None:
            base, stored = materialise(base), True
    keys = base.select(KEY, "diag_date", "pabx_str")
    near = index_bounds(keys) if stored else UNBOUNDED  # one row of the stored base
    bounds = C.episode_bounds(cat.exposure_starts, cat.exposure_ends)
    expo = C.exposure_bounds(keys, bounds)                                   # first_abx_dt, pabx_end
    df = C.attach(
        base,
        C.contact_days(keys, cat.gp_events, params, near),
        expo,
        C.dose_at_start(keys, cat.prescriptions),
        C.next_episode_start(expo, cat.exposure_starts),
        C.first_exposure_ever(keys, cat.exposure_starts, bounds, near),
        C.practice_rate(keys, cat.registration, cat.practice_rate),
        E.lab_fold(keys, cat.urine_tests, params, near),                      # O14, and O26-O28, O33 for the outcome tables
        C.baseline_uti_counts_gp(keys, cat.gp_uti, cat.hosp_uti, params, near),
        C.baseline_uti_counts_hosp(keys, cat.hosp_uti, params, near),
        zero=("gp_int_days", "amr_baseline"))
    df = C.override_exit_reason(df, params)
    return C.earliest_end(df, params)


# ---------------------------------------------------------------- patient facts used by the outcome tables
def patient_facts(pre: DataFrame, cat: SourceCatalog, params: StudyParams, exclude: bool = True,
                  bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """O34, O35, O37a and the O38b exclusion on the one-row-per-patient table (O33 came with the baseline).

    The study deletes O38b's patients from the finished outcome table; the rule is
    per patient, so dropping them here, before the panel is exploded, gives the same table.
    """
    idx = O.clamp_exposure(pre.where(col("diag_date").isNotNull()))
    keys = idx.select(KEY, "diag_date", "pabx_str_c")
    df = C.attach(idx, O.exposure_type(keys, cat.exposure_starts, params, bounds), O.next_event_date(keys, cat.all_uti, bounds))
    if not exclude:
        return df
    return df.join(O.started_before_index(keys, cat.exposure_starts), KEY, "left_anti")


# ---------------------------------------------------------------- the outcome template on the stacked panel
def panel_buckets(spark, patients: int, outcomes: int, params: StudyParams) -> int:
    """Partitions for the panel of so many patients and outcomes."""
    return P.partitions(spark, patients * outcomes * P.most_intervals(params))


def stacked_panel(facts: DataFrame, dates_wide: DataFrame | None, params: StudyParams, outcome_ids,
                  patients: int | None = None, buckets: int | None = None) -> DataFrame:
    """(patient x outcome x interval) rows with the panel flags (O16-O20) and the outcome date.

    Outcome dates are columns ``od_<id>`` of ``facts`` (those of the tests) or of ``dates_wide``. With the
    number of ``patients`` (at most) the rows are dealt by what they become, before they are exploded; with
    ``buckets`` into that many partitions.
    """
    outs = F.array(*[F.struct(F.lit(i).alias("outcome_id"), col(f"od_{i}").alias("outcome_dt"))
                     for i in outcome_ids])
    base = (with_dates(facts, dates_wide)
            .withColumnsRenamed({"diag_date": "ruti_diag_dt", "gp_end_date": "gp_end_dt"})
            .withColumn("study_end", F.lit(params.study_end)))
    if buckets is None and patients is not None:
        buckets = panel_buckets(base.sparkSession, patients, len(outcome_ids), params)
    if buckets is not None:
        base = base.repartition(buckets, KEY)
    base = base.select(*[c for c in base.columns if not c.startswith("od_")], F.inline(outs))
    spine = P.interval_spine(col("ruti_diag_dt"), col("min_end_dt"), params.step_days)
    df = base.select("*", F.posexplode(spine).alias("cal_time", "cal_dt"))
    step = params.step_days
    return df.withColumns({
        "pabx": P.on_exposure("pabx_str", "pabx_end", step),
        "all_pabx": P.on_exposure("pabx_str_all", "pabx_end_all", step),
        **P.exit_flags(params),
    })


def with_dates(facts: DataFrame, dates_wide: DataFrame | None) -> DataFrame:
    return facts if dates_wide is None else facts.join(dates_wide, KEY, "left")


#: What the interval rules read of a patient; everything else is attached after them.
PANEL_FACTS = ("diag_date", "gp_end_date", "dod", "min_end_dt", "cohort_end_reason", "next_pabx_str", "pabx_str", "pabx_end",
               "pabx_str_all", "pabx_end_all", "next_uti_dt")


def attach_late(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """The patient's other columns on the finished panel rows.

    Both sides are partitioned by patient and the panel is sorted by it already, so the wide columns are
    shuffled once per patient and never sorted or repeated before the windows are done.
    """
    late = [c for c in facts.columns if c not in panel.columns and c not in PANEL_FACTS and not c.startswith("od_")]
    return panel.join(facts.select(KEY, *late), KEY)


def missing_dates(cat: SourceCatalog, pre: DataFrame, params: StudyParams, outcome_ids, bounds: IndexBounds = UNBOUNDED,
                  materialise=None) -> DataFrame | None:
    """The outcome dates that the baseline does not hold yet."""
    todo = [i for i in outcome_ids if f"od_{i}" not in pre.columns]
    return E.outcome_dates(cat, pre, params, todo, bounds, materialise) if todo else None


def outcome_template(df: DataFrame, params: StudyParams) -> DataFrame:
    """O29-O32, O36, O37b on the stacked panel."""
    df = df.withColumn("outcome", O.outcome_flag(params))
    df = O.resolve_competing(df, params)
    df = O.trim_after(df)
    df = O.inclusion_days(df, params)
    return df.withColumns({"death_after_outcome": O.death_after_outcome(), "next_uti": O.next_event_flag(params)})


def all_outcomes(cat: SourceCatalog, params: StudyParams, outcome_ids=None, pre: DataFrame | None = None,
                 bounds: IndexBounds = UNBOUNDED, materialise=None, buckets: int | None = None) -> DataFrame:
    """O38d: the six outcome tables in one pass, stacked on ``outcome_id``.

    ``bounds`` is the range of index dates of a stored ``pre`` (``bounds.index_bounds``);
    ``materialise`` stores the cohort's spells and the patient's facts, which are read twice. Only
    the dates that the interval rules need go through the explosion and the windows. With ``buckets`` the
    rows come out by patient in that many partitions.
    """
    outcome_ids = sorted(outcome_ids or E.OUTCOMES)
    pre = pre if pre is not None else baseline_cohort(cat, params)
    wide = missing_dates(cat, pre, params, outcome_ids, bounds, materialise)
    facts = patient_facts(pre, cat, params, bounds=bounds)
    if materialise is not None:  # read twice: for the panel, and for what is attached after it
        facts = materialise(facts)
    narrow = facts.select(KEY, *PANEL_FACTS, *[c for c in facts.columns if c.startswith("od_")])
    patients = facts.count() if materialise is not None and buckets is None else None
    panel = outcome_template(stacked_panel(narrow, wide, params, outcome_ids, patients, buckets), params)
    return O.assemble(attach_late(panel, facts), params)


__all__ = ["exit_cohort", "baseline_cohort", "patient_facts", "stacked_panel", "outcome_template", "all_outcomes"]
