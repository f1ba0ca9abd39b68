"""The interval spine against the study's recursion, and the flags."""

import datetime as dt

from pyspark.sql import functions as F

from trialspark.operators import panel as P
from trialspark.params import StudyParams


def recursion(start, end, step=7):
    out = [start]
    while out[-1] + dt.timedelta(days=step - 1) < end:
        out.append(out[-1] + dt.timedelta(days=step))
    return out


def test_spine_equals_recursion_for_all_durations(spark):
    start = dt.date(2016, 2, 29)
    rows = [(d, start, start + dt.timedelta(days=d)) for d in range(-10, 400)]
    df = spark.createDataFrame(rows, "d int, s date, e date")
    got = {r.d: r.sp for r in df.select("d", P.interval_spine(F.col("s"), F.col("e"), 7).alias("sp")).collect()}
    for d, s, e in rows:
        assert got[d] == recursion(s, e), d
        assert len(got[d]) == max(0, d) // 7 + 1 or d < 0


def test_spine_null_end_gives_one_row(spark):
    df = spark.createDataFrame([(dt.date(2016, 1, 1), None)], "s date, e date")
    assert df.select(F.size(P.interval_spine(F.col("s"), F.col("e"), 7))).first()[0] == 1


def test_flags(spark):
    params = StudyParams()
    base = dict(alf_pe="a", diag_date=dt.date(2016, 1, 1), first_abx_dt=None, pabx_str=dt.date(2016, 1, 10),
                pabx_end=dt.date(2016, 1, 20), gp_end_date=None, dod=dt.date(2016, 2, 3), next_pabx_str=None,
                cohort_end_reason="DIED", min_end_dt=dt.date(2016, 2, 3), pabx_str_all=None,
                pabx_all_first_script=None, pabx_end_all=None)
    schema = ("alf_pe string, diag_date date, first_abx_dt date, pabx_str date, pabx_end date, gp_end_date date, "
              "dod date, next_pabx_str date, cohort_end_reason string, min_end_dt date, pabx_str_all date, "
              "pabx_all_first_script date, pabx_end_all date")
    df = spark.createDataFrame([tuple(base.values())], schema)
    rows = P.panel(df, params).orderBy("cal_time").collect()
    assert [r.cal_time for r in rows] == [0, 1, 2, 3, 4]
    # exposure 10..20 Jan: interval starting 8 Jan contains the start, 15 Jan is inside
    assert [r.pabx for r in rows] == [0, 1, 1, 0, 0]
    # death on 3 Feb is in the interval starting 29 Jan
    assert [r.death for r in rows] == [0, 0, 0, 0, 1]
    assert sum(r.ltf + r.study_ended + r.new_pabx + r.diag_12months for r in rows) == 0
