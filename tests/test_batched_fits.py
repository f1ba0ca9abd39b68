"""Batched Newton fits, aliased terms, array sums and the exact quantile of all replicates."""

import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from trialspark.operators import emulate as M
from trialspark.operators import irls
from trialspark.operators import replicates as R
from trialspark.operators import survival as S
from trialspark.operators import weights as W
from trialspark.params import FIXTURE_PARAMS
from trialspark.plans import analysis as A
from trialspark.plans.session import cut

SF = "/root/testdata/sf0.001"


def _glr(rows, label, columns, weight=None):
    """Coefficients by Spark ML, an implementation of its own."""
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol=label, maxIter=50, tol=1e-12)
    if weight:
        glr = glr.setWeightCol(weight)
    model = glr.fit(data)
    return np.array([model.intercept, *model.coefficients])


def _rows(n=2500, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(60, 10, n), rng.integers(0, 13, n), rng.integers(0, 2, n)])
    eta = -1.0 + 0.03 * (x[:, 0] - 60) - 0.1 * x[:, 1] + 0.6 * x[:, 2]
    y = rng.random(n) < 1 / (1 + np.exp(-eta))
    return x, y.astype(float), rng.poisson(1.0, (n, 5)).astype(float)


def test_batched_fits_equal_glr_for_every_weighting(spark):
    x, y, m = _rows()
    design = np.column_stack([np.ones(len(x)), x])
    sums = lambda beta, moving: np.stack([_dense(irls.chunk_sums(iter([(np.zeros(len(y), int), y, design, m)]), beta, moving), moving, beta)])
    fits = irls.newton(sums, np.ones((1, 5, 4), bool))
    assert fits.converged.all() and (fits.iterations < 12).all()
    df = spark.createDataFrame([(*map(float, r), float(v), *map(float, w)) for r, v, w in zip(x, y, m)],
                               "a double, t double, d double, y double, w0 double, w1 double, w2 double, w3 double, w4 double")
    for b in (0, 3):
        assert np.allclose(fits.beta[0, b], _glr(df, "y", ["a", "t", "d"], f"w{b}"), atol=1e-6)


def _dense(found, moving, beta):
    p = beta.shape[2]
    out = np.zeros((moving.shape[1], p * (p + 1) // 2 + p + 1))
    for o, v in found.items():
        out[np.flatnonzero(moving[o])] = v
    return out


def test_aliased_terms_are_dropped_in_term_order(spark):
    x, y, _ = _rows(800)
    rows = [(float(a), float(t), float(d), float(2 * a - t), 7.0, float(1 - d), float(v)) for (a, t, d), v in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, t double, d double, sum double, const double, other double, y double")
    fit = W.fit_logit(df, "y", ["a", "t", "const", "sum", "d", "other"])
    assert set(fit.coefficients) == {"a", "t", "d"}  # const, 2a - t and 1 - d add nothing
    ref = _glr(df, "y", ["a", "t", "d"])
    assert np.allclose([fit.intercept, *[fit.coefficients[c] for c in ("a", "t", "d")]], ref, atol=1e-6)


def test_fit_that_does_not_settle_raises(spark):
    x, y, _ = _rows(300)
    df = spark.createDataFrame([(float(a), float(v)) for (a, _, _), v in zip(x, y)], "a double, y double")
    with pytest.raises(RuntimeError, match="did not converge"):
        W.fit_logit(df, "y", ["a"], max_iter=1)


def test_solve_equals_numpy_and_skips_empty_models():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 50, 4))
    gram, score = np.einsum("nij,nik->njk", x, x), rng.normal(size=(3, 4))
    gram[2] = 0.0
    got, used = irls.solve(gram, score, np.ones((3, 4), bool), 1e-9)
    for i in (0, 1):
        assert np.allclose(got[i], np.linalg.solve(gram[i], score[i]))
    assert used[:2].all() and not used[2].any() and not got[2].any()


def _patients(spark, seed=2, n=60, outcomes=(1, 4)):
    """A panel with ties, empty arms, missing covariates and unequal lengths."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(n):
        age, rate = float(rng.integers(20, 90)), (None if p % 11 == 0 else float(rng.integers(1, 5)))
        for o in outcomes:
            start = int(rng.integers(0, 30))
            size = int(rng.integers(1, 25))
            for t in range(size):
                rows.append((f"p{p}", o, t, int(t == start), int(rng.random() < 0.08) if p % 7 else 0, age, rate, int(rng.integers(0, 2)) if t == 0 else p % 2))
    df = spark.createDataFrame(rows, "alf string, outcome_id int, cal_time int, pabx_start int, outcome int, ruti_age double, gp_prescrib_rate double, diab int")
    for c in W.NUMERIC:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df.withColumns({"frailty": F.col("diab"), "wimd": F.lit(1), "most_recent_urine": (F.col("ruti_age") % 3).cast("int")})


def test_refits_equal_one_replicate_at_a_time(spark):
    """Against a plain path: each replicate's rows by themselves, GLR fits, exact quantile, survival."""
    params = FIXTURE_PARAMS
    prep = cut(A.prepared(_patients(spark), params))
    reps, stuck = A.refit_effects(prep, params, [1, 4], replicates=4, seed=3, materialise=cut)
    got = {(r.outcome_id, r.rep): r for r in reps.collect()}
    assert set(stuck) == {1, 4}
    terms = A.design(prep, [1, 4])
    mults = S.multiplicities(F.col("alf"), 4, 3)
    clones = M.censor_clones(prep, params).select("alf", "outcome_id", "arm", "cal_time", "outcome")
    checked = 0
    for b in (1, 3):
        rows = prep.withColumn("mult", F.element_at(mults, b).cast("int")).where("mult > 0")
        fits = {}
        for k, oid in enumerate(terms.outcome_ids):
            full = rows.where((F.col("outcome_id") == oid) & (F.col("at_risk") == 1))
            levels = W.factor_levels(full.where("complete"), A.denominator_terms()[1])[oid]
            den = W.fit_logit(full.where("complete"), "pabx_start", A.denominator_terms()[0], levels, weight="mult")
            num = W.fit_logit(full, "pabx_start", W.TIME, weight="mult")
            glr = _glr(full.withColumn("cal_time", F.col("cal_time").cast("double")), "pabx_start", ["cal_time", "time_sq"], "mult")
            assert np.allclose([num.intercept, *[num.coefficients[c] for c in W.TIME]], glr, atol=1e-5)
            fits[oid] = (den, num)
        w = A.with_fitted(rows, fits).select("alf", "outcome_id", "cal_time", "sw_a", "mult")
        capped = W.truncate_weights(clones.join(w, ["alf", "outcome_id", "cal_time"]), params, "sw_a", "sw_trunc", ["outcome_id"], count="mult")
        capped = capped.where("sw_trunc is not null").withColumn("sw_trunc", F.col("sw_trunc") * F.col("mult"))
        for r in A.effects(capped).collect():
            have = got[(r.outcome_id, b)]
            for c in ("r1", "r0", "rd"):
                if r[c] is None:
                    assert have[c] is None
                else:
                    assert have[c] == pytest.approx(r[c], abs=1e-6), (r.outcome_id, b, c)
                    checked += 1
    assert checked >= 8


def test_weight_quantiles_are_exact(spark):
    """Order statistics by digits of the bits equal numpy's, counted by multiplicity and kept arms."""
    params = FIXTURE_PARAMS
    prep = cut(A.prepared(_patients(spark, seed=9, n=40), params))
    terms = A.design(prep, [1, 4])
    patients = cut(A.refit_patients(prep, params, terms, 3, 5))
    rng = np.random.default_rng(1)
    weights = R.Weights(rng.normal(scale=0.02, size=(2, 3, len(terms.terms))), rng.normal(scale=0.1, size=(2, 3, 3)))
    for q in (0.5, 0.97, 0.9995, 1.0):
        got = R.weight_quantiles(patients, weights, q)
        values = {}
        for rows, owner, times in R.patient_chunks(iter(patients.toArrow().to_batches())):
            outcome, _, sw = weights.of(rows, owner)
            count = (times * R.numbers(rows, "keep")[:, None]).astype(int)
            for i, b in zip(*np.nonzero((count > 0) & ~np.isnan(sw))):
                values.setdefault((outcome[i], b), []).extend([sw[i, b]] * count[i, b])
        for (o, b), v in values.items():
            assert got[o, b] == pytest.approx(np.quantile(v, q), rel=1e-14), (q, o, b)


def test_fixed_weight_sums_read_each_row_once(spark):
    clones = spark.createDataFrame([(f"p{i % 9}", 1 + i % 2, i % 3 % 2, i % 4, 0.5 + i / 7, (None, 0, 1)[i % 3]) for i in range(90)],
                                   "alf string, outcome_id int, arm int, cal_time int, sw_trunc double, outcome int")
    sums = R.fixed_weight_sums(clones, 6, seed=2)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row per replicate
    mult = {r.alf: list(r.m) for r in clones.select("alf", S.multiplicities(F.col("alf"), 6, 2).alias("m")).distinct().collect()}
    want = {}
    for r in clones.collect():
        if r.outcome is not None:
            v = want.setdefault((r.outcome_id, r.arm, r.cal_time), np.zeros(12))
            risk = r.sw_trunc * np.array(mult[r.alf])
            v += np.concatenate([risk, risk * r.outcome])
    got = {(r.outcome_id, r.arm, r.cal_time): r.v for r in sums.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_intervals_of_both_bootstraps_on_the_fixture(spark):
    from trialspark.plans import registry as Q
    ci = Q.QUERIES["bootstrap_refit_ci"](spark, SF).collect()
    assert {r.outcome_id for r in ci} <= {1, 2, 3, 4, 5, 6}
    for r in ci:
        assert r.replicates <= 200 and (r.rd_lo is None or r.rd_lo <= r.rd_hi)


def test_late_rows_share_the_weight_of_the_last_row_at_risk(spark):
    """Rows after the risk is over are kept apart, and every known row still counts in the curves."""
    params = FIXTURE_PARAMS
    prep = cut(A.prepared(_patients(spark, seed=9, n=40), params).where("complete"))
    terms = A.design(prep, [1, 4])
    patients = cut(A.refit_patients(prep, params, terms, 3, 5))
    at_risk, late = prep.where("outcome_id in (1, 4) and at_risk = 1").count(), prep.where("outcome_id in (1, 4) and at_risk = 0").count()
    held = patients.agg(F.sum(F.size("rows")), F.sum(F.size("late"))).first()
    assert (held[0], held[1]) == (at_risk, late) and late > 0
    weights = R.Weights(np.zeros((2, 3, len(terms.terms))), np.zeros((2, 3, 3)))  # all probabilities 1/2: every weight is 1
    sums = {(r.outcome_id, r.arm, r.cal_time): r.v for r in R.refitted_sums(patients, weights, np.full((2, 3), np.inf), [1, 4]).collect()}
    clones = A.M.censor_clones(prep, params).where("outcome_id in (1, 4)").withColumn("sw_trunc", F.lit(1.0))
    fixed = {(r.outcome_id, r.arm, r.cal_time): r.v for r in R.fixed_weight_sums(clones, 3, 5).collect()}
    assert sums.keys() == fixed.keys()
    assert all(np.allclose(sums[k], fixed[k]) for k in fixed)


def test_panel_is_dealt_by_the_rows_it_becomes(spark, monkeypatch):
    """A few patients fill as many tasks as their panel rows need, however small their exchange is."""
    from trialspark.operators import panel as P
    monkeypatch.setattr(P, "PANEL_ROWS", 100)
    few = spark.range(30).select(F.col("id").cast("string").alias("alf_pe"))
    assert P.spread(few, "alf_pe", 30 * 6 * P.most_intervals(FIXTURE_PARAMS)).rdd.getNumPartitions() == 98
