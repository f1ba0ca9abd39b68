"""Exact type-7 quantile, weighted KM, effect measures, logistic fit, bootstrap."""

import numpy as np
from pyspark.sql import functions as F

from trialspark.operators import survival as S
from trialspark.operators import weights as W


def test_type7_quantile_matches_numpy_small_and_banded(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in ((1, 7), (2, 500), (3, 4000)) for v in rng.lognormal(0, 1, n)]
    rows += [(2, 5.0)] * 30  # ties
    df = spark.createDataFrame(rows, "g int, w double")
    for acc in (100, 100_000):  # 100 forces the bracketed band on groups 2 and 3
        got = {r.g: r.quantile for r in W.type7_quantile(df, "w", ["g"], 0.9995, accuracy=acc).collect()}
        for g in (1, 2, 3):
            vals = np.array([v for gg, v in rows if gg == g])
            assert abs(got[g] - np.quantile(vals, 0.9995)) < 1e-12, (g, acc)


def test_weighted_km_with_unit_weights_is_life_table(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("b", 1, 0), ("b", 2, 0), ("c", 0, 1), ("d", 0, None)]
    df = spark.createDataFrame([(a, t, e, 1.0, 1, 0) for a, t, e in rows],
                               "alf string, cal_time int, outcome int, sw_trunc double, outcome_id int, arm int")
    curve = {r.cal_time: r.surv for r in S.weighted_km(df, ["outcome_id", "arm"]).collect()}
    # t0: 3 known at risk, 1 event; t1: 2 at risk, 1 event; t2: 1 at risk, 0 events
    assert abs(curve[0] - 2 / 3) < 1e-12 and abs(curve[1] - 1 / 3) < 1e-12 and abs(curve[2] - 1 / 3) < 1e-12


def test_effect_measures(spark):
    final = spark.createDataFrame([(1, 1, 0.8), (1, 0, 0.9)], "outcome_id int, arm int, surv double")
    r = S.effect_measures(final, ["outcome_id"]).first()
    assert abs(r.r1 - 0.2) < 1e-12 and abs(r.r0 - 0.1) < 1e-12 and abs(r.rd - 0.1) < 1e-12
    assert abs(r.rr - 2.0) < 1e-9 and abs(r.nnt - 10.0) < 1e-9


def _irls(X, y, w, iters=50):
    beta = np.zeros(X.shape[1])
    for _ in range(iters):
        eta = X @ beta
        mu = 1 / (1 + np.exp(-eta))
        wt = w * mu * (1 - mu)
        z = eta + (y - mu) / (mu * (1 - mu))
        beta = np.linalg.solve(X.T @ (wt[:, None] * X), X.T @ (wt * z))
    return beta


def test_logit_matches_numpy_irls_individual_and_grouped(spark):
    rng = np.random.default_rng(11)
    n = 3000
    t = rng.integers(0, 13, n).astype(float)
    age = rng.normal(60, 10, n)
    lvl = rng.choice(["1", "2", "3"], n)
    eta = -1.0 - 0.1 * t + 0.02 * (age - 60) + np.where(lvl == "2", 0.5, 0.0) + np.where(lvl == "3", -0.4, 0.0)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    df = spark.createDataFrame([(int(yy), float(tt), float(tt * tt), float(aa), str(ll))
                                for yy, tt, aa, ll in zip(y, t, age, lvl)],
                               "y int, cal_time double, time_sq double, age double, f string")
    fit = W.fit_logit(df, "y", ["cal_time", "time_sq", "age"], {"f": ["1", "2", "3"]})
    X = np.column_stack([np.ones(n), t, t * t, age, (lvl == "2").astype(float), (lvl == "3").astype(float)])
    ref = _irls(X, y.astype(float), np.ones(n))
    got = np.array([fit.intercept] + [fit.coefficients[k] for k in ["cal_time", "time_sq", "age", "f=2", "f=3"]])
    assert np.allclose(got, ref, atol=1e-6)
    # grouped binomial data (proportion + count) give the same time model
    grouped = (df.groupBy("cal_time", "time_sq").agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n")))
    g = W.fit_logit(grouped, "p", ["cal_time", "time_sq"], weight="n")
    i = W.fit_logit(df, "y", ["cal_time", "time_sq"])
    assert abs(g.intercept - i.intercept) < 1e-6
    assert all(abs(g.coefficients[k] - i.coefficients[k]) < 1e-6 for k in ("cal_time", "time_sq"))
    # the column expression reproduces the model's probability
    p = df.select(fit.probability().alias("p")).first().p
    assert 0 < p < 1


def test_poisson_thresholds_and_resample_counts(spark):
    th = S.poisson1_thresholds()
    assert abs(th[0] - np.exp(-1)) < 1e-15 and abs(th[1] - 2 * np.exp(-1)) < 1e-15 and th[-1] < 1
    pats = spark.createDataFrame([(str(i),) for i in range(2000)], "alf string")
    drawn = pats.select(F.explode(S.multiplicities(F.col("alf"), 20, 5)).alias("mult")).where("mult > 0")
    counts = drawn.agg(F.sum("mult").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert abs(counts.s / 40000 - 1.0) < 0.03           # mean multiplicity ~ 1
    assert abs(counts.n / 40000 - (1 - np.exp(-1))) < 0.02  # share with count > 0
