"""O40-O42 against the censoring rule by the place of the first initiation (all binary vectors)."""

import itertools

from pyspark.sql import functions as F

from trialspark.operators import emulate as M
from trialspark.params import AS_DOCUMENTED, StudyParams


def first_start(p):
    """Place (from 1) of the first initiation after the index row."""
    return next((k for k, treated in enumerate(p[1:], 2) if treated), None)


def untreated_leaves(p, grace=12):
    """At the initiation up to place 4; from place 5 to the end of the grace period one row later, if there is one."""
    j = first_start(p)
    if j is None or j > grace:
        return None
    return j if j <= 4 else j + 1 if j < len(p) else None


def treated_leaves(p, grace=12):
    """In the row after the grace period, if no initiation came by then."""
    j = first_start(p)
    return grace + 1 if len(p) > grace and (j is None or j > grace + 1) else None


def _vectors(max_len):
    for n in range(1, max_len + 1):
        for bits in itertools.product((0, 1), repeat=n):
            yield bits


def _frame(spark, max_len):
    rows = []
    for i, v in enumerate(_vectors(max_len)):
        rows += [(str(i), 1, t, b, 0) for t, b in enumerate(v)]
    return spark.createDataFrame(rows, "alf string, outcome_id int, cal_time int, pabx_start int, outcome int")


def test_censor_positions_match_the_rule_on_all_vectors(spark):
    params = StudyParams()
    df = _frame(spark, 14)
    got = (df.select("alf", M.censor_no_treat(params).alias("c0"), M.censor_no_start(params).alias("c1"))
           .distinct().collect())
    got = {r.alf: (r.c0, r.c1) for r in got}
    for i, v in enumerate(_vectors(14)):
        assert got[str(i)] == (untreated_leaves(v), treated_leaves(v)), v


def test_documented_arm0_censors_at_first_initiation(spark):
    params = StudyParams(mode=AS_DOCUMENTED)
    df = spark.createDataFrame([("a", 1, t, int(t == 6), 0) for t in range(20)],
                               "alf string, outcome_id int, cal_time int, pabx_start int, outcome int")
    assert {r.c for r in df.select(M.censor_no_treat(params).alias("c")).collect()} == {7}


def test_keep_until_first_censored_and_blank_outcome(spark):
    params = StudyParams()
    # initiation at position 3 (cal_time 2): arm 0 censored at 3; arm 1 never censored
    rows = [("a", 1, t, int(t >= 2), int(t == 5)) for t in range(8)]
    df = spark.createDataFrame(rows, "alf string, outcome_id int, cal_time int, pabx_start int, outcome int")
    out = M.censor_clones(df, params).orderBy("arm", "cal_time").collect()
    arm0 = [r for r in out if r.arm == 0]
    arm1 = [r for r in out if r.arm == 1]
    assert [r.cal_time for r in arm0] == [0, 1, 2]
    assert arm0[-1].my_censor == 1 and arm0[-1].outcome is None
    assert len(arm1) == 8 and sum(r.my_censor for r in arm1) == 0 and arm1[5].outcome == 1
    assert "PythonUDF" not in M.censor_clones(df, params)._jdf.queryExecution().executedPlan().toString()


def test_clone_arms_doubles_rows(spark):
    df = spark.range(5).withColumn("x", F.lit(1))
    assert M.clone_arms(df).count() == 10
