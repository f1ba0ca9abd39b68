"""Fits on a row a patient, the panel stored where it is, the hospital hierarchy joined once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import events as E
from trialspark.operators import irls
from trialspark.plans import analysis as A
from trialspark.plans import registry as R
from trialspark.plans.session import cut

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
SMALL = (["cal_time", "ruti_age", "time_sq", "diab"], ["frailty_lvl"])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_covariates_of_a_patient_are_kept_once(spark):
    prep = R._prepared(spark, SF).where("at_risk = 1")
    patients = A.patients_at_risk(prep)
    assert patients.count() == prep.select("alf").distinct().count() < prep.count()
    back = patients.select("alf", F.inline("rows"))
    keys = ["alf", "outcome_id", "cal_time", "pabx_start"]
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, prep.select(*keys).collect()))


def test_fits_by_patient_equal_fits_of_single_rows(spark):
    """Also where covariates differ within a patient, and rows are not complete."""
    prep = R._prepared(spark, SF).withColumn("diab", F.when(F.col("cal_time") % 3 == 1, 1 - F.col("diab")).otherwise(F.col("diab")))
    prep = prep.withColumn("complete", F.col("complete") & (F.col("ruti_age") % 7 != 0))
    ids = [1, 3, 6]
    fits = A.fit_models(prep, ids, SMALL, cut)
    rows = prep.where((F.col("at_risk") == 1) & F.col("complete") & F.col("outcome_id").isin(ids))
    terms = A.design(prep, ids, SMALL)
    flat = rows.select(terms.index().alias("o"), F.col("pabx_start").cast("double").alias("y"), F.lit(1.0).alias("w"), terms.row().alias("x"))
    plain = irls.newton(irls.newton_sums(flat, irls.flat_chunks), terms.allowed[:, None])
    for k, i in enumerate(ids):
        den = fits[i][0]
        got = [den.intercept, *[den.coefficients.get(t, 0.0) for t in terms.terms[1:]]]
        assert np.allclose(got, plain.beta[k, 0], atol=1e-7)


def test_the_panel_is_stored_by_patient_and_read_where_it_is(spark):
    prep = R._prepared(spark, SF)
    assert "Exchange" not in _plan(prep) and "Exchange" not in _plan(A.patients_at_risk(prep))
    files = prep.inputFiles()
    assert len(files) == len({f.rsplit("_", 1)[1] for f in files})  # one file a bucket


def test_the_lines_of_others_orders_are_not_read_again(spark):
    cat, pre = R._pre(spark, SF)
    orders = cat.spell.select(F.col("spell_num_pe").alias("report_seq")).distinct()
    assert cat.urine_tests.join(orders, "report_seq", "left_anti").count() == 0
    whole = R._cat(spark, SF).urine_tests.join(orders, "report_seq", "left_semi").select(*cat.urine_tests.columns)
    assert sorted(map(repr, cat.urine_tests.collect())) == sorted(map(repr, whole.collect()))


def test_co_occurring_joins_the_hierarchy_once(spark):
    for baseline, params in ((R._pre, R.PARAMS), (R._pre_documented, R.DOCUMENTED)):
        cat, pre = baseline(spark, SF)
        code = F.col("diag_cd_1234")
        uti = E.hospital_events(cat.diagnosis, cat.episode, cat.spell, pre, E.uti_code(code), params)
        both = E.co_occurring(uti, E.hospital_resistance_events(cat, pre, params), params)
        want = E.exclude_recent_discharge(both, cat.spell, params).select(*R._EV).distinct()
        got = R._co_occurring((cat, pre), params)
        assert _plan(got).count("lineitem") == 0 and "l_partkey" not in _plan(got)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
