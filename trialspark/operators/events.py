"""Outcome event operators (O23-O28) and the six outcome definitions.

Each outcome reduces to one date per patient (its first event). The study reads
the tests once (``lab_fold``) and the hospital hierarchy once (``hospital_dates``) for
all of them; the single operators serve one definition at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import codes
from trialspark.functions.dates import any_of, between, lit_date, plus_years
from trialspark.functions.predicates import any_resistant, specimen_indicator, specimen_rank
from trialspark.operators.bounds import UNBOUNDED, IndexBounds
from trialspark.operators.joins import KEY
from trialspark.params import StudyParams

col = F.col

# outcome ids (fixed): one per outcome table of the study
OUTCOMES = {
    1: "hosp_amr",          # hospital admission with a resistance code
    2: "hosp_amr_uti",      # ... and a UTI code in the same spell
    3: "urine_amr",         # urine test resistant to any of nine antibiotics
    4: "urine_amr_2plus",   # ... to two or more
    5: "urine_trim",        # ... to trimethoprim
    6: "urine_nitro",       # ... to nitrofurantoin
}

EVENT_COLUMNS = [KEY, "prov_unit_cd", "spell_num_pe", "admis_dt", "disch_dt", "epi_num", "epi_str_dt",
                 "epi_end_dt", "diag_cd_1234"]


def resistance_code(code: Column) -> Column:
    return code.isin(*codes.RESISTANCE_CODES)


def uti_code(code: Column) -> Column:
    return any_of(code.contains(p) for p in codes.UTI_CODE_PATTERNS)


# ---------------------------------------------------------------- O23
def hospital_events(diagnosis: DataFrame, episode: DataFrame, spell: DataFrame, cohort: DataFrame,
                    code_predicate: Column, params: StudyParams) -> DataFrame:
    """Coded diagnosis -> episode in the study years -> spell -> patient.

    The episode must start after index (up to study end) and within two days of admission.
    The code filter reaches the diagnosis scan, the year filter the episode scan.
    """
    d = diagnosis.where(code_predicate).select("prov_unit_cd", "spell_num_pe", "epi_num", "diag_cd_1234")
    e = (episode.where(between("epi_str_dt", lit_date(params.study_start), lit_date(params.study_end)))
         .select("prov_unit_cd", "spell_num_pe", "epi_num", "epi_str_dt", "epi_end_dt"))
    sp = spell.select(KEY, "prov_unit_cd", "spell_num_pe", "admis_dt", "disch_dt")
    ev = (d.join(e, ["prov_unit_cd", "spell_num_pe", "epi_num"])
          .join(sp, ["prov_unit_cd", "spell_num_pe"])
          .join(cohort.select(KEY, "diag_date"), KEY)
          .where(between("epi_str_dt", F.date_add("diag_date", 1), lit_date(params.study_end))
                 & between("epi_str_dt", "admis_dt", F.date_add("admis_dt", params.admission_window_days))))
    return ev.select(*EVENT_COLUMNS)


# ---------------------------------------------------------------- O24
def near_discharges(events: DataFrame, spell: DataFrame, params: StudyParams, how: str = "inner") -> DataFrame:
    """``events`` (patient, event date, own spell ``_own``...) with the patient's discharges 0..3 days before.

    Equi-join on (patient, discharge date): each event is expanded to its
    four candidate discharge dates, spells are reduced to min/max spell number
    per (patient, discharge date). No pairing of a patient's events with all spells.
    """
    gap = params.discharge_gap_days
    cand = events.select("*", F.explode(F.sequence(F.lit(0), F.lit(gap))).alias("_off")) \
        .withColumn("disch_dt", F.date_sub("epi_str_dt", col("_off"))).drop("_off")
    sp = (spell.where(col("disch_dt").isNotNull())
          .groupBy(KEY, "disch_dt").agg(F.min("spell_num_pe").alias("_mn"), F.max("spell_num_pe").alias("_mx")))
    return cand.join(sp, [KEY, "disch_dt"], how)


def other_spell() -> Column:
    """Some spell discharged that day differs from the event's own."""
    return (col("_mn") != col("_own")) | (col("_mx") != col("_own"))


def recent_discharge_keys(events: DataFrame, spell: DataFrame, params: StudyParams) -> DataFrame:
    """(patient, event date) pairs with a discharge of a *different* spell 0..3 days before."""
    keys = events.select(KEY, "epi_str_dt", col("spell_num_pe").alias("_own")).distinct()
    return near_discharges(keys, spell, params).where(other_spell()).select(KEY, "epi_str_dt").distinct()


def exclude_recent_discharge(events: DataFrame, spell: DataFrame, params: StudyParams) -> DataFrame:
    """Drop every event of a patient on a date within 3 days after another spell's discharge."""
    return events.join(recent_discharge_keys(events, spell, params), [KEY, "epi_str_dt"], "left_anti")


# ---------------------------------------------------------------- O25
def co_occurring(uti_events: DataFrame, res_events: DataFrame, params: StudyParams) -> DataFrame:
    """UTI-coded events in a spell (as written) / episode (as documented) with a resistance event."""
    keys = [KEY, "prov_unit_cd", "spell_num_pe"] + (["epi_num"] if params.documented else [])
    return uti_events.join(res_events.select(*keys), keys, "left_semi")


# ---------------------------------------------------------------- O26, O27
def lab_events(cohort: DataFrame, tests: DataFrame, predicate: Column) -> DataFrame:
    """Specimens collected after index that match ``predicate``."""
    return (tests.where(predicate).select(KEY, "spcm_collected_dt", "report_seq", "request_seq")
            .join(cohort.select(KEY, "diag_date"), KEY)
            .where(col("spcm_collected_dt") > col("diag_date")))


def resistant_count(params: StudyParams) -> Column:
    """Per test group: resistances summed over rows (as written) or distinct drugs (as documented)."""
    terms = []
    for group in codes.MULTI_RESISTANCE_GROUPS:
        hit = any_of(col(c) == codes.RESISTANT for c in group)
        flag = F.when(hit, 1)
        terms.append(F.max(F.coalesce(flag, F.lit(0))) if params.documented else F.count(flag))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def multi_resistant_events(cohort: DataFrame, tests: DataFrame, params: StudyParams, min_count: int = 2) -> DataFrame:
    """Test groups (patient, date, report, request) with >= ``min_count`` resistances, after index.

    Groups with a NULL key never join back to their rows in the study, so they are dropped.
    """
    keys = [KEY, "spcm_collected_dt", "report_seq", "request_seq"]
    # a group without any resistance can't reach the count, so its rows need not be shuffled
    groups = (tests.where(any_resistant())
              .where(col(KEY).isNotNull() & col("spcm_collected_dt").isNotNull()
                          & col("report_seq").isNotNull() & col("request_seq").isNotNull())
              .groupBy(*keys).agg(resistant_count(params).alias("resistant_count"))
              .where(col("resistant_count") >= min_count))
    return (groups.join(cohort.select(KEY, "diag_date"), KEY)
            .where(col("spcm_collected_dt") > col("diag_date")))


# ---------------------------------------------------------------- O14, O26, O27, O33 in one fold
#: More than the ranks a specimen can have.
RANKS = 1 << 8
LAB_FACTS = ("amr_baseline", "most_recent_urine", "od_3", "od_4", "od_5", "od_6")


def lab_fold(keys: DataFrame, tests: DataFrame, params: StudyParams, bounds: IndexBounds = UNBOUNDED) -> DataFrame:
    """O14, O26, O27, O28 and O33 of every patient from one scan, one join and one exchange of the tests.

    Each row is reduced to small codes below the join (which rules it meets, its resistance groups as a
    bit mask, the rank of its outcome). The tests of a report are then combined (O27 counts them
    together) and folded into one row per patient: conditional minima for first dates, a flag, and the
    greatest (date, rank) for the specimen closest to the index. Both groupings use the patient's
    partitions, so nothing is shuffled again. Rows that no rule can use (before the earliest look-back,
    or later and without a resistance) do not leave the scan.
    """
    day, index = "spcm_collected_dt", col("diag_date")
    hits = {3: any_resistant(params.antibiotics), 5: col("trimethoprim") == codes.RESISTANT, 6: col("nitrofurantoin") == codes.RESISTANT}
    groups = [any_of(col(c) == codes.RESISTANT for c in group) for group in codes.MULTI_RESISTANCE_GROUPS]
    some = any_of([*hits.values(), *groups])
    mask = F.lit(0)
    for i, g in enumerate(groups):
        mask = mask + F.when(g, 1 << i).otherwise(0)
    lookback = max(params.specimen_lookback_years * 366, params.resistance_lookback_days)
    rows = (tests.where(bounds.since(day, days=-lookback) & (some | bounds.until(day)))
            .select(KEY, day, "report_seq", "request_seq", specimen_rank().alias("_rank"), mask.alias("_mask"),
                    *[F.coalesce(p, F.lit(False)).alias(f"_p{k}") for k, p in hits.items()]))
    j = (rows.join(keys.select(KEY, "diag_date"), KEY)
         .where((col(day) > index) & (col("_p3") | (col("_mask") > 0) | col("_p5") | col("_p6"))
                | between(day, F.date_sub(index, params.resistance_lookback_days), index)
                | between(day, plus_years("diag_date", -params.specimen_lookback_years), index)))
    count = F.bit_count(F.bit_or("_mask")) if params.documented else F.sum(F.bit_count("_mask"))
    report = j.groupBy(KEY, "diag_date", day, "report_seq", "request_seq").agg(
        F.min("_rank").alias("_rank"), count.alias("_n"), *[F.max(f"_p{k}").alias(f"_p{k}") for k in hits])
    after = col(day) > index
    several = (col("_n") >= 2) & col("report_seq").isNotNull() & col("request_seq").isNotNull()
    near = between(day, plus_years("diag_date", -params.specimen_lookback_years), index)
    first = {**{k: col(f"_p{k}") for k in hits}, 4: several}
    folded = report.groupBy(KEY).agg(
        F.max(F.when(between(day, F.date_sub(index, params.resistance_lookback_days), index) & col("_p3"), 1)).alias("amr_baseline"),
        # (day, rank) as one number: the greatest of a struct would need a sort
        F.max(F.when(near, F.unix_date(day).cast("long") * RANKS - col("_rank"))).alias("_best"),
        *[F.min(F.when(after & rule, col(day))).alias(f"od_{k}") for k, rule in sorted(first.items())])
    return folded.select(KEY, "amr_baseline", specimen_indicator(F.pmod(-col("_best"), F.lit(RANKS)).cast("int"), params).alias("most_recent_urine"),
                         *[f"od_{k}" for k in sorted(first)])


# ---------------------------------------------------------------- O28
def first_event(events: DataFrame, date_col: str) -> DataFrame:
    """Earliest event date per patient (only the date is used downstream)."""
    return events.groupBy(KEY).agg(F.min(date_col).alias("outcome_dt"))


# ---------------------------------------------------------------- O23-O25 in one pass
def hospital_dates(diagnosis: DataFrame, episode: DataFrame, spell: DataFrame, cohort: DataFrame, params: StudyParams) -> DataFrame:
    """O23, O24, O25 and O28 of outcomes 1 and 2: ``(alf_pe, od_1, od_2)``, the hierarchy joined once.

    A diagnosis carries its code sets as two flags through one three-table join. A spell (as written;
    an episode as documented) has a resistance code if the window over it has one; O24's hit belongs
    to a (patient, date, own spell), so it is looked up once for both outcomes, and drops a date for
    an outcome if an event of that outcome on that date has a hit.
    """
    code = col("diag_cd_1234")
    both = hospital_events(diagnosis, episode, spell, cohort, resistance_code(code) | uti_code(code), params)
    unit = [KEY, "prov_unit_cd", "spell_num_pe"] + (["epi_num"] if params.documented else [])
    flagged = both.select(*unit, "epi_str_dt", resistance_code(code).alias("_res"), uti_code(code).alias("_uti"))
    flagged = flagged.withColumn("_two", col("_uti") & F.max("_res").over(Window.partitionBy(*unit)))
    events = flagged.where(col("_res") | col("_two")).groupBy(KEY, "epi_str_dt", col("spell_num_pe").alias("_own")).agg(
        F.max("_res").alias("_e1"), F.max("_two").alias("_e2"))
    marked = near_discharges(events, spell, params, "left")
    hit = F.coalesce(other_spell(), F.lit(False))
    dates = marked.groupBy(KEY, "epi_str_dt").agg(*[F.max(col(f"_e{k}")).alias(f"_e{k}") for k in (1, 2)],
                                                  *[F.max(col(f"_e{k}") & hit).alias(f"_x{k}") for k in (1, 2)])
    return dates.groupBy(KEY).agg(*[F.min(F.when(col(f"_e{k}") & ~col(f"_x{k}"), col("epi_str_dt"))).alias(f"od_{k}") for k in (1, 2)])


# ---------------------------------------------------------------- the six outcomes
def hospital_resistance_events(cat, cohort: DataFrame, params: StudyParams) -> DataFrame:
    return hospital_events(cat.diagnosis, cat.episode, cat.spell, cohort,
                           resistance_code(col("diag_cd_1234")), params)


def cohort_spells(spell: DataFrame, cohort: DataFrame, materialise=None) -> DataFrame:
    """Spells of cohort patients, in the columns the rules read; stored if ``materialise`` is given."""
    own = spell.select(KEY, "prov_unit_cd", "spell_num_pe", "admis_dt", "disch_dt").join(cohort.select(KEY), KEY, "left_semi")
    return materialise(own) if materialise is not None else own


def outcome_dates(cat, cohort: DataFrame, params: StudyParams, outcome_ids, bounds: IndexBounds = UNBOUNDED,
                  materialise=None) -> DataFrame:
    """First date of every outcome, one row per patient: ``(alf_pe, od_<id>...)``.

    The hospital hierarchy and the tests are read once each; with ``materialise`` so are the spells,
    which O23 and O24 both need, reduced to the cohort's.
    """
    parts = []
    if {1, 2} & set(outcome_ids):
        spells = cohort_spells(cat.spell, cohort, materialise)
        parts.append(hospital_dates(cat.diagnosis, cat.episode, spells, cohort, params))
    if {3, 4, 5, 6} & set(outcome_ids):
        parts.append(lab_fold(cohort.select(KEY, "diag_date"), cat.urine_tests, params, bounds))
    parts = [p.select(KEY, *[c for c in p.columns if c in {f"od_{i}" for i in outcome_ids}]) for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], KEY, "full")


def outcome_dates_long(wide: DataFrame) -> DataFrame:
    """One row per patient and outcome that happened: ``(alf_pe, outcome_id, outcome_dt)``."""
    ids = sorted(int(c[3:]) for c in wide.columns if c.startswith("od_"))
    stacked = F.array(*[F.struct(F.lit(i).alias("outcome_id"), col(f"od_{i}").alias("outcome_dt")) for i in ids])
    return wide.select(KEY, F.inline(stacked)).where(col("outcome_dt").isNotNull())
