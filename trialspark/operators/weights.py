"""Treatment weights.

Models are fitted by :mod:`irls`: each Newton step is one distributed pass that
adds up the normal equations. Predictions are turned back into a column expression
of the fitted coefficients, so scoring stays in codegen and needs no vector column.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trialspark.operators import irls
from trialspark.params import StudyParams

col = F.col
PATIENT = ["alf", "outcome_id"]

# numeric covariates of the denominator model and their squares (R's ``.sqrd`` / ``timesqr``)
NUMERIC = ["ruti_age", "gp_prescrib_rate", "immun_supp", "diab", "renal_stone", "urin_tract_abnorm",
           "utis_hosp_baseline", "utis_gp_baseline", "amr_baseline"]
SQUARED = ["ruti_age", "gp_prescrib_rate", "utis_hosp_baseline", "utis_gp_baseline"]
FACTORS = ["frailty", "wimd", "most_recent_urine"]
TIME = ["cal_time", "time_sq"]

# levels a factor may have; each is a column of the model
MAX_LEVELS = 200


def model_features(df: DataFrame, params: StudyParams) -> DataFrame:
    """Squares, factor levels as strings, NULL counts -> 0 (D13), and ``complete``.

    D23, missing covariates: as written, a row without a rate, a factor or another covariate is
    not ``complete``: the denominator model neither uses it nor gives it a probability, so the
    patient has no weight from there on (as ``glm`` and ``predict`` treat missing values). As
    documented, a missing rate counts as 0 and a missing factor as a level ``NA``, and every
    row is complete.
    """
    out = df.withColumns({c: F.coalesce(col(c), F.lit(0)) for c in ("utis_gp_baseline", "utis_hosp_baseline")})
    if params.documented:
        out = out.withColumn("gp_prescrib_rate", F.coalesce(col("gp_prescrib_rate"), F.lit(0.0)))
    out = out.withColumns({f"{c}_sq": col(c).cast("double") * col(c).cast("double") for c in SQUARED})
    out = out.withColumn("time_sq", col("cal_time").cast("double") * col("cal_time").cast("double"))
    missing = F.lit("NA") if params.documented else F.lit(None).cast("string")
    out = out.withColumns({f"{c}_lvl": F.coalesce(col(c).cast("string"), missing) for c in FACTORS})
    known = F.lit(True)
    for c in [*NUMERIC, *[f"{f}_lvl" for f in FACTORS]]:
        known = known & col(c).isNotNull()
    return out.withColumn("complete", known)


def at_risk(params: StudyParams, treat: str = "pabx_start") -> Column:
    """D17 (not defined in the study): 1 up to and including the first initiation inside the grace period."""
    w = Window.partitionBy(*PATIENT)
    first = F.min(F.when((col(treat) == 1) & (col("cal_time") >= 1), col("cal_time"))).over(w)
    g = params.grace_weeks
    return F.when((col("cal_time") <= g) & (first.isNull() | (col("cal_time") <= first)), 1).otherwise(0)


@dataclasses.dataclass
class LogitFit:
    intercept: float
    coefficients: dict[str, float]   # column -> coefficient; dummies as "<factor>_lvl=<level>"
    iterations: int
    converged: bool = True           # False: the iteration cap was reached

    def linear(self) -> Column:
        expr = F.lit(self.intercept)
        for name, beta in self.coefficients.items():
            if "=" in name:
                factor, level = name.split("=", 1)
                term = F.when(col(factor) == level, F.lit(beta)).otherwise(F.lit(0.0))
            else:
                term = col(name).cast("double") * F.lit(beta)
            expr = expr + term
        return expr

    def probability(self) -> Column:
        return logistic(self.linear())


def logistic(eta: Column) -> Column:
    """Inverse logit as R's binomial ``linkinv``: the linear predictor is clamped at +-30, so a
    probability is never exactly 0 or 1 (no infinite weight). Pass a column, not a long expression."""
    eps = 2.220446049250313e-16  # double machine epsilon
    t = F.when(eta < -30, F.lit(eps)).when(eta > 30, F.lit(1.0 / eps)).otherwise(F.exp(eta))
    return t / (F.lit(1.0) + t)


def factor_levels(df: DataFrame, factors: list[str], by: str = "outcome_id") -> dict[int, dict[str, list[str]]]:
    """Per group: the sorted levels of each factor. A factor with more than ``MAX_LEVELS`` levels fails the job."""
    counts = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(f).alias(f) for f in factors]).first()
    wide = [f for f in factors if counts[f] > MAX_LEVELS]
    if wide:
        raise ValueError(f"factors with more than {MAX_LEVELS} levels: {wide}")
    rows = df.groupBy(by).agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(f)).alias(f) for f in factors]).collect()
    return {row[by]: {f: list(row[f]) for f in factors} for row in rows}


def design(numeric: list[str], levels: dict[str, list[str]]) -> tuple[list[Column], list[str]]:
    """Numeric columns plus 0/1 dummies for every level but the first (R's reference level)."""
    cols = [col(c).cast("double") for c in numeric]
    names = list(numeric)
    for f, lv in levels.items():
        for level in lv[1:]:
            cols.append(F.when(col(f) == level, 1.0).otherwise(0.0))
            names.append(f"{f}={level}")
    return cols, names


def fit_logit(df: DataFrame, label: str, numeric: list[str], levels: dict[str, list[str]] | None = None,
              weight: str | None = None, max_iter: int = irls.MAX_ITER) -> LogitFit:
    """One logistic regression by Newton steps, each a single aggregation.

    ``label`` may be a proportion with ``weight`` trials: grouped binomial data give the same
    estimates as the individual rows. Aliased terms (linear combinations of earlier ones, constants
    among them) have no coefficient, as in R. Raises if the fit does not converge.
    """
    cols, names = design(numeric, levels or {})
    rows = df.select(F.lit(0).alias("o"), col(label).cast("double").alias("y"),
                     (col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.array(F.lit(1.0), *cols).alias("x"))
    fits = irls.newton(irls.newton_sums(rows, irls.flat_chunks), np.ones((1, 1, len(cols) + 1), bool), max_iter)
    if not fits.converged.all():
        raise RuntimeError(f"the logistic fit of {label} did not converge in {max_iter} steps")
    used = {n: float(b) for n, b, u in zip(names, fits.beta[0, 0, 1:], fits.used[0, 0, 1:]) if u}
    return LogitFit(float(fits.beta[0, 0, 0]), used, int(fits.iterations[0, 0]))


def prob_of_received(p: Column, treat: str = "pabx_start", risk: str = "at_risk") -> Column:
    """Probability of the treatment actually received; 1 where not at risk."""
    return F.when(col(risk) == 1, F.when(col(treat) == 1, p).otherwise(F.lit(1.0) - p)).otherwise(F.lit(1.0))


def stabilised_weight(num: str = "p_num_t", den: str = "p_den_t") -> Column:
    """Running product of numerator over running product of denominator, in time order.

    A fitted probability of exactly 0 or 1 makes the denominator 0; the ratio is then
    +Inf (NaN for 0/0) as in R, and the truncation caps it. From the first row without a
    probability on there is no weight (D23).
    """
    w = Window.partitionBy(*PATIENT).orderBy("cal_time").rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.product(col(num)).over(w), F.product(col(den)).over(w)
    gap = F.max(F.when(col(num).isNull() | col(den).isNull(), 1)).over(w)
    return (F.when(gap.isNotNull(), F.lit(None)).when(d != 0, n / d).when(n == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))


def type7_quantile(df: DataFrame, value: str, group: list[str], q: float, count: str | None = None,
                   accuracy: int = 100_000) -> DataFrame:
    """Exact R type-7 quantile per group: ``(group..., n, quantile)``, a row each on the driver.

    ``count`` says how often a row's value occurs (default once). ``percentile_approx`` brackets
    the two order statistics needed; one pass counts what lies below the bracket, and the
    distinct values inside it, with their counts, are cumulated. Equal values are one row there,
    however many they are. Where a bracket misses its ranks it is widened and the pass repeated,
    up to the whole range, so the result never depends on the bracket.
    """
    times = col(count).cast("long") if count else F.lit(1).cast("long")
    rows = df.select(*group, col(value).cast("double").alias("_v"), times.alias("_c")).where(
        col("_v").isNotNull() & (col("_c") > 0))
    sizes = {tuple(r[:-1]): r[-1] for r in map(tuple, rows.groupBy(*group).agg(F.sum("_c")).collect())}
    found: dict[tuple, float] = {}
    delta = 4.0 / accuracy
    while len(found) < len(sizes):
        lo_q, hi_q = max(0.0, q - delta), min(1.0, q + delta)
        whole = lo_q == 0.0 and hi_q == 1.0
        edges = [F.min("_v"), F.max("_v")] if whole else [F.percentile_approx("_v", x, accuracy) for x in (lo_q, hi_q)]
        band = rows.groupBy(*group).agg(edges[0].alias("_lo"), edges[1].alias("_hi"))
        near = rows.join(F.broadcast(band), group)  # one row per group
        below = near.groupBy(*group).agg(F.sum(F.when(col("_v") < col("_lo"), col("_c")).otherwise(0)).alias("_below"))
        w = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        values = (near.where((col("_v") >= col("_lo")) & (col("_v") <= col("_hi"))).groupBy(*group, "_v")
                  .agg(F.sum("_c").alias("_c")).withColumn("_upto", F.sum("_c").over(w)).join(F.broadcast(below), group)
                  .withColumn("_upto", col("_upto") + col("_below")))
        size = F.create_map(*[x for k, n in sizes.items() for x in (F.concat_ws("|", *[F.lit(v) for v in k]), F.lit(n))])
        h = (F.element_at(size, F.concat_ws("|", *[col(g).cast("string") for g in group])) - 1) * F.lit(q)
        # the first value whose cumulated count exceeds a rank is the order statistic of that rank
        at = values.groupBy(*group).agg(
            F.min(F.when(col("_upto") > F.floor(h), col("_v"))).alias("x0"),
            F.min(F.when(col("_upto") > F.ceil(h), col("_v"))).alias("x1"), F.first("_below").alias("below"))
        for *key, x0, x1, under in map(tuple, at.collect()):
            h_key = (sizes[tuple(key)] - 1) * q
            if x0 is not None and x1 is not None and under <= int(h_key):
                found.setdefault(tuple(key), x0 if x0 == x1 else x0 + (h_key - int(h_key)) * (x1 - x0))
        if whole and len(found) < len(sizes):
            raise RuntimeError("quantile not found in the whole range")
        delta *= 16
    fields = [f for f in df.select(*group).schema]
    schema = StructType([*fields, StructField("n", LongType()), StructField("quantile", DoubleType())])
    return df.sparkSession.createDataFrame([(*k, sizes[k], x) for k, x in found.items()], schema)


def truncate_weights(df: DataFrame, params: StudyParams, weight: str = "sw_a", out: str = "sw_trunc",
                     group: list[str] | None = None, count: str | None = None) -> DataFrame:
    """Cap weights above the ``weight_q`` quantile of the cloned rows' weights (per outcome).

    The threshold table has one row per group, so it is broadcast. A group without a threshold
    has no weight to cap.
    """
    group = group or ["outcome_id"]
    thr = type7_quantile(df, weight, group, params.weight_q, count).select(*group, col("quantile").alias("_thr"))
    return (df.join(F.broadcast(thr), group, "left")
            .withColumn(out, F.when(col(weight) > col("_thr"), col("_thr")).otherwise(col(weight))).drop("_thr"))
