"""Cardinality errors, the weighted quantile, hot patients, D9 and sizing."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import cohort as C
from trialspark.operators import weights as W
from trialspark.params import AS_DOCUMENTED, StudyParams
from trialspark.plans.session import cluster_conf

D = dt.date


def _keys(spark):
    return spark.createDataFrame([("a", D(2016, 6, 1)), ("b", D(2016, 6, 1)), ("c", D(2016, 6, 1))], "alf_pe string, diag_date date")


def test_practice_rate_takes_one_value_and_raises_on_two(spark):
    reg = [("a", "p1", D(2016, 1, 1), D(2016, 6, 1)), ("a", "p2", D(2016, 6, 1), D(2017, 1, 1)), ("b", "p1", D(2015, 1, 1), D(2016, 1, 1))]
    reg = spark.createDataFrame(reg, "alf_pe string, prac_cd_pe string, start_date date, end_date date")
    same = spark.createDataFrame([("p1", 1.25), ("p2", 1.25)], "prac_cd_pe string, abx_presc_rt double")
    assert [tuple(r) for r in C.practice_rate(_keys(spark), reg, same).collect()] == [("a", 1.25)]
    other = spark.createDataFrame([("p1", 1.25), ("p2", 2.5)], "prac_cd_pe string, abx_presc_rt double")
    with pytest.raises(Exception, match="CardinalityError"):
        C.practice_rate(_keys(spark), reg, other).collect()


def test_gp_episode_inside_one_of_two_hospital_episodes(spark):
    kind = "alf_pe string, event_str_dt date, event_end_dt date, data_source string"
    gp = spark.createDataFrame([("a", D(2016, 3, 5), D(2016, 3, 5), "WLGP"), ("b", D(2016, 3, 5), D(2016, 3, 5), "WLGP")], kind)
    hosp = spark.createDataFrame([("a", D(2016, 3, 1), D(2016, 3, 9), "PEDW"), ("a", D(2016, 5, 1), D(2016, 5, 9), "PEDW"),
                                  ("b", D(2016, 3, 5), D(2016, 3, 9), "PEDW")], kind)
    count = lambda p: {r[0]: r[1] for r in C.baseline_uti_counts_gp(_keys(spark), gp, hosp, p).collect()}
    assert count(StudyParams()) == {"a": 1, "b": 1}
    assert count(StudyParams(mode=AS_DOCUMENTED)) == {"b": 1}


def test_weighted_quantile_counts_ties_and_widens_its_bracket(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v), int(c)) for g in (1, 2) for v, c in zip(rng.choice([0.5, 1.0, 2.0, 7.0], 3000), rng.poisson(1, 3000))]
    df = spark.createDataFrame(rows, "g int, w double, c int")
    for q in (0.0, 0.37, 0.9995, 1.0):
        got = {r.g: r.quantile for r in W.type7_quantile(df, "w", ["g"], q, count="c", accuracy=50_000).collect()}
        for g in (1, 2):
            values = np.repeat([v for k, v, c in rows if k == g], [c for k, v, c in rows if k == g])
            assert abs(got[g] - np.quantile(values, q)) < 1e-12


def test_a_hot_patient_brings_one_row_a_day(spark):
    days = spark.range(40_000).select(F.lit("a").alias("alf_pe"), F.expr("date_add(date'2016-06-02', cast(id % 300 as int))").alias("event_dt"),
                                      F.lit("A1").alias("event_cd"))
    out = C.contact_days(_keys(spark), days, StudyParams())
    assert [tuple(r) for r in out.collect()] == [("a", 300)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join"):]  # days are combined below the join


def test_partitions_have_a_bound():
    assert cluster_conf(100 << 40, 8000)["spark.sql.shuffle.partitions"] == "40000"
    assert cluster_conf(1 << 30, 8)["spark.sql.shuffle.partitions"] == "16"


def test_missing_covariates_as_written_and_as_documented(spark):
    row = {"alf": "a", "outcome_id": 1, "cal_time": 0, "pabx_start": 0, **{c: 1 for c in W.NUMERIC}, **{f: "2" for f in W.FACTORS}}
    rows = [row, {**row, "gp_prescrib_rate": None}, {**row, "frailty": None}, {**row, "utis_gp_baseline": None}]
    kind = ", ".join(f"{c} {'string' if c == 'alf' or c in W.FACTORS else 'int'}" for c in row)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    assert [r.complete for r in W.model_features(df, StudyParams()).collect()] == [True, False, False, True]
    out = W.model_features(df, StudyParams(mode=AS_DOCUMENTED)).collect()
    assert all(r.complete for r in out) and out[1].gp_prescrib_rate == 0 and out[2].frailty_lvl == "NA" and out[3].utis_gp_baseline == 0


def test_no_weight_from_the_first_missing_probability_on(spark):
    rows = [("a", 1, t, 0.5, None if t == 2 else 0.25) for t in range(4)]
    df = spark.createDataFrame(rows, "alf string, outcome_id int, cal_time int, p_num_t double, p_den_t double")
    got = [r.w for r in df.select("cal_time", W.stabilised_weight().alias("w")).orderBy("cal_time").collect()]
    assert got == [2.0, 4.0, None, None]


def test_antibiotics_are_a_parameter(spark):
    tests = spark.createDataFrame([("a", D(2016, 5, 1), "Resistant", "Sensitive"), ("b", D(2016, 5, 1), "Sensitive", "Resistant")],
                                  "alf_pe string, spcm_collected_dt date, trimethoprim string, nitrofurantoin string")
    only = StudyParams(antibiotics=("nitrofurantoin",))
    assert [r[0] for r in C.baseline_resistance(_keys(spark), tests, only).collect()] == ["b"]
