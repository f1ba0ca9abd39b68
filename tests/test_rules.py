"""Hand-made patients, one per rule of O2, O11, O15, O21, O24, O29-O31 (with their NULL cases)."""

import datetime as dt

from pyspark.sql import functions as F

from trialspark.operators import cohort as C
from trialspark.operators import events as E
from trialspark.operators import outcomes as O
from trialspark.params import AS_DOCUMENTED, StudyParams

D = dt.date
P = StudyParams()


def _exit(spark, rows):
    cohort = spark.createDataFrame(
        [(a, diag, wob, gp) for a, diag, wob, gp, _ in rows],
        "alf_pe string, diag_date date, wob date, gp_end_date date")
    deaths = spark.createDataFrame([(a, d) for a, _, _, _, d in rows if d is not None], "alf_pe string, death_dt date")
    out = C.follow_up_exit(cohort, deaths, P).collect()
    return {r.alf_pe: (r.cohort_end_dt, r.cohort_end_reason) for r in out}


def test_exit_rules_each_branch(spark):
    wob = D(1960, 1, 1)
    got = _exit(spark, [
        ("12m", D(2016, 3, 1), wob, D(2019, 1, 1), None),          # follow-up ends first
        ("ltf", D(2016, 3, 1), wob, D(2016, 8, 1), None),          # GP registration ends, no death
        ("died", D(2016, 3, 1), wob, D(2016, 8, 1), D(2016, 8, 2)),  # death the day after GP end
        ("ltf2", D(2016, 3, 1), wob, D(2016, 8, 1), D(2016, 9, 1)),  # GP end well before death
        ("nogp", D(2016, 3, 1), wob, None, None),                  # NULL GP end: no rule holds
        ("late12m", D(2020, 6, 1), wob, D(2023, 1, 1), None),      # 12 months after study end
    ])
    assert got["12m"] == (D(2017, 3, 1), "DG +12mths")
    assert got["ltf"] == (D(2016, 8, 1), "LTF")
    assert got["died"] == (D(2016, 8, 2), "DIED")
    assert got["ltf2"] == (D(2016, 8, 1), "LTF")
    assert got["nogp"] == (D(2020, 12, 31), "STUDY END")
    assert got["late12m"] == (D(2021, 6, 1), "STUDY END")


def test_index_on_29_february_adds_12_months_to_28th(spark):
    got = _exit(spark, [("leap", D(2016, 2, 29), D(1960, 1, 1), D(2019, 1, 1), None)])
    assert got["leap"] == (D(2017, 2, 28), "DG +12mths")


def test_new_episode_override_and_min_end(spark):
    rows = [("a", D(2016, 1, 1), D(2016, 5, 1), None, "DG +12mths", D(2016, 4, 1)),
            ("b", D(2016, 1, 1), D(2016, 5, 1), None, "DG +12mths", None),   # 3VL: no next start
            ("c", D(2016, 1, 1), D(2016, 5, 1), D(2016, 6, 1), "DIED", None),
            ("d", D(2016, 1, 1), None, None, "STUDY END", D(2016, 4, 1))]      # NULL GP end blocks NEW PABX
    df = spark.createDataFrame(rows, "alf_pe string, diag_date date, gp_end_date date, dod date, "
                                     "cohort_end_reason string, next_pabx_str date")
    out = {r.alf_pe: r for r in C.earliest_end(C.override_exit_reason(df, P), P).collect()}
    assert out["a"].cohort_end_reason == "NEW PABX" and out["a"].min_end_dt == D(2016, 4, 1)
    assert out["b"].cohort_end_reason == "DG +12mths" and out["b"].min_end_dt == D(2016, 5, 1)
    assert out["c"].min_end_dt == D(2016, 6, 1)       # reason DIED within 12 months: death date, not least()
    assert out["d"].cohort_end_reason == "STUDY END" and out["d"].min_end_dt == D(2016, 4, 1)


def test_gp_uti_dropped_only_when_every_hospital_episode_covers_it(spark):
    keys = spark.createDataFrame([("a", D(2016, 6, 1)), ("b", D(2016, 6, 1)), ("c", D(2016, 6, 1))],
                                 "alf_pe string, diag_date date")
    gp = spark.createDataFrame([("a", D(2016, 3, 5), D(2016, 3, 5), "WLGP"), ("b", D(2016, 3, 5), D(2016, 3, 5), "WLGP"),
                                ("c", D(2016, 3, 5), D(2016, 3, 5), "WLGP")],
                               "alf_pe string, event_str_dt date, event_end_dt date, data_source string")
    hosp = spark.createDataFrame([("a", D(2016, 3, 1), D(2016, 3, 10), "PEDW"),   # a: covered by its only episode
                                  ("b", D(2016, 3, 1), D(2016, 3, 10), "PEDW"),   # b: covered by one, not the other
                                  ("b", D(2016, 1, 1), D(2016, 1, 3), "PEDW"),
                                  ("c", D(2016, 3, 1), None, "PEDW")],            # c: NULL end -> unknown -> dropped
                                 "alf_pe string, event_str_dt date, event_end_dt date, data_source string")
    out = {r.alf_pe: r.gp_uti_pre for r in C.baseline_uti_counts_gp(keys, gp, hosp, P).collect()}
    assert out == {"b": 1}


def test_recent_discharge_of_other_spell_drops_the_whole_day(spark):
    ev = spark.createDataFrame([("a", "P1", 10, D(2016, 5, 1), D(2016, 5, 4), 1, D(2016, 5, 4), D(2016, 5, 4), "U820"),
                                ("a", "P1", 11, D(2016, 5, 4), D(2016, 5, 6), 1, D(2016, 5, 4), D(2016, 5, 6), "U820"),
                                ("b", "P1", 20, D(2016, 5, 1), D(2016, 5, 2), 1, D(2016, 5, 1), D(2016, 5, 2), "U820")],
                               "alf_pe string, prov_unit_cd string, spell_num_pe long, admis_dt date, disch_dt date, "
                               "epi_num int, epi_str_dt date, epi_end_dt date, diag_cd_1234 string")
    spell = ev.select("alf_pe", "prov_unit_cd", "spell_num_pe", "admis_dt", "disch_dt").distinct()
    out = E.exclude_recent_discharge(ev, spell, P).collect()
    # a: spell 10 was discharged on 4 May, the episode of spell 11 starts that day -> both rows of that day go
    assert [(r.alf_pe, r.spell_num_pe) for r in out] == [("b", 20)]


def _template_rows(spark, outcome_dt, next_dt, params):
    rows = [("a", 1, t, D(2016, 1, 1) + dt.timedelta(days=7 * t), D(2016, 1, 1), outcome_dt, next_dt,
             None, None, D(2020, 12, 31), 0, 0, 0, 0, int(next_dt is not None and t == 2))
            for t in range(5)]
    df = spark.createDataFrame(rows, "alf_pe string, outcome_id int, cal_time int, cal_dt date, ruti_diag_dt date, "
                                     "outcome_dt date, next_pabx_str date, dod date, gp_end_dt date, study_end date, "
                                     "death int, ltf int, study_ended int, diag_12months int, new_pabx int")
    df = df.withColumn("outcome", O.outcome_flag(params))
    return O.trim_after(O.resolve_competing(df, params)).orderBy("cal_time").collect()


def test_same_day_outcome_and_new_episode(spark):
    day = D(2016, 1, 16)  # inside the interval starting 15 Jan (cal_time 2)
    as_written = _template_rows(spark, day, day, P)
    assert [r.cal_time for r in as_written] == [0, 1, 2]
    assert as_written[-1].outcome == 0 and as_written[-1].new_pabx == 1      # D4: new exposure wins
    documented = _template_rows(spark, day, day, StudyParams(mode=AS_DOCUMENTED))
    assert documented[-1].outcome == 1 and documented[-1].new_pabx == 0     # outcome wins


def test_outcome_earlier_in_same_interval_wins_and_trims(spark):
    rows = _template_rows(spark, D(2016, 1, 15), D(2016, 1, 17), P)
    assert [r.cal_time for r in rows] == [0, 1, 2]
    assert rows[-1].outcome == 1 and rows[-1].new_pabx == 0


def test_outcome_after_death_is_not_counted(spark):
    df = spark.createDataFrame([("a", 1, 0, D(2016, 1, 1), D(2016, 1, 1), D(2016, 1, 5), D(2016, 1, 3), None,
                                 D(2020, 12, 31))],
                               "alf_pe string, outcome_id int, cal_time int, cal_dt date, ruti_diag_dt date, "
                               "outcome_dt date, dod date, gp_end_dt date, study_end date")
    assert df.select(O.outcome_flag(P).alias("o")).first().o == 0


def test_closest_specimen_ranks_same_day_results(spark):
    keys = spark.createDataFrame([("a", D(2016, 6, 1)), ("b", D(2016, 6, 1))], "alf_pe string, diag_date date")
    tests = spark.createDataFrame([("a", D(2016, 5, 1), "Mixed growth"), ("a", D(2016, 5, 1), "Possible UTI"),
                                   ("a", D(2016, 1, 1), "Confirmed UTI"), ("b", D(2016, 5, 1), "Unlisted"),
                                   ("b", D(2016, 5, 1), "Exclude NULL culture")],
                                  "alf_pe string, spcm_collected_dt date, uti_outcome string")
    out = {r.alf_pe: r.most_recent_urine for r in O.closest_specimen(keys, tests, P).collect()}
    assert out == {"a": 1, "b": 0}
    doc = {r.alf_pe: r.most_recent_urine for r in O.closest_specimen(keys, tests, StudyParams(mode=AS_DOCUMENTED))
           .collect()}
    assert doc["b"] == 3


def test_dose_multi_single_none(spark):
    keys = spark.createDataFrame([("m", D(2016, 1, 1)), ("s", D(2016, 1, 1)), ("n", D(2016, 1, 1))],
                                 "alf_pe string, pabx_str date")
    rx = spark.createDataFrame([("m", D(2016, 1, 1), 3, "A", "low", "c"), ("m", D(2016, 1, 1), 3, "B", "low", "c"),
                                ("s", D(2016, 1, 1), 3, "A", "low", "c"), ("s", D(2016, 1, 1), 3, "A", "low", "c"),
                                ("n", D(2016, 1, 1), 2, "A", "low", "c")],
                               "alf_pe string, event_dt date, event_in_grp int, antibx_category string, dose string, "
                               "dose_consistency string")
    out = {r.alf_pe: (r.dose, r.dose_consistency) for r in C.dose_at_start(keys, rx).collect()}
    assert out == {"m": ("Multi", "Multi"), "s": ("low", "c")}


def test_trim_keeps_rows_when_dates_are_null(spark):
    rows = _template_rows(spark, None, None, P)
    assert len(rows) == 5 and all(r.outcome == 0 for r in rows)
    assert F  # module used


def test_source_cardinality_checks(spark):
    import pytest

    from trialspark.operators.joins import CardinalityError, assert_unique, duplicate_keys
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "alf_pe string, x int")
    assert [tuple(r) for r in duplicate_keys(df, "alf_pe").collect()] == [("a", 2)]
    with pytest.raises(CardinalityError):
        assert_unique(df, "alf_pe", "deaths")
    assert_unique(df.where("alf_pe = 'b'"), "alf_pe")
