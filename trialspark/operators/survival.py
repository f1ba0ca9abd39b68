"""Weighted survival, effect measures and bootstrap intervals.

``Surv(time, time + 1, event)`` with weights: at each time ``t`` the risk set is
the rows with ``time == t`` and a known outcome, so the Kaplan-Meier factor is
``1 - sum(w * event) / sum(w)`` over those rows. The panel is reduced to one
row per (group, time) by a partial aggregation before any window is applied;
the product over time then runs on at most ~53 rows per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col = F.col


def km_steps(df: DataFrame, group: list[str], weight: str = "sw_trunc", event: str = "outcome",
             time: str = "cal_time") -> DataFrame:
    """Risk set and events per (group, time): ``n_risk``, ``n_event`` (weighted)."""
    known = df.where(col(event).isNotNull())
    return known.groupBy(*group, time).agg(
        F.sum(col(weight)).alias("n_risk"),
        F.sum(col(weight) * col(event)).alias("n_event"))


def weighted_km(df: DataFrame, group: list[str], weight: str = "sw_trunc", event: str = "outcome",
                time: str = "cal_time") -> DataFrame:
    """The weighted survival curve per group: ``(group..., time, n_risk, n_event, surv)``."""
    return product_limit(km_steps(df, group, weight, event, time), group, time)


def product_limit(steps: DataFrame, group: list[str], time: str = "cal_time") -> DataFrame:
    """``surv``, the running product over time of one less the share of events, from ``km_steps``."""
    factor = F.lit(1.0) - F.coalesce(F.try_divide(col("n_event"), col("n_risk")), F.lit(0.0))
    w = Window.partitionBy(*group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("surv", F.product(factor).over(w))


def final_survival(curve: DataFrame, group: list[str]) -> DataFrame:
    """``min(surv)`` per group (the survival at the end of follow-up)."""
    return curve.groupBy(*group).agg(F.min("surv").alias("surv"))


def effect_measures(final: DataFrame, by: list[str], arm: str = "arm") -> DataFrame:
    """Risks per arm, risk difference, risk ratio, number needed to treat."""
    piv = final.groupBy(*by).agg(
        F.max(F.when(col(arm) == 1, col("surv"))).alias("s1"),
        F.max(F.when(col(arm) == 0, col("surv"))).alias("s0"))
    r1, r0 = F.lit(1.0) - col("s1"), F.lit(1.0) - col("s0")
    return piv.select(*by, r1.alias("r1"), r0.alias("r0"), (r1 - r0).alias("rd"),
                      F.try_divide(r1, r0).alias("rr"), F.try_divide(F.lit(1.0), r1 - r0).alias("nnt"))


# ---------------------------------------------------------------- O53 bootstrap
def poisson1_thresholds(bits: int = 32) -> list[float]:
    """CDF of Poisson(1) at 0, 1, ... as far as a uniform of ``bits`` bits can reach.

    Beyond the last value no such uniform lies, so nothing is cut off.
    """
    out, acc, term, k = [], 0.0, math.exp(-1.0), 0
    while acc < 1.0 - 2.0 ** -bits:
        acc += term
        out.append(acc)
        k += 1
        term /= k
    return out


def uniform_from_md5(key: Column) -> Column:
    """A uniform in [0, 1) from the first 32 bits of ``md5(key)`` (reproducible in any SQL engine)."""
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(2 ** 32))


def multiplicities(key: Column, replicates: int, seed: int) -> Column:
    """Poisson(1) multiplicities of a patient in replicates 1, 2, ... as one array."""
    draw = lambda r: uniform_from_md5(F.concat_ws(":", key.cast("string"), r.cast("string"), F.lit(str(seed))))
    return F.transform(F.transform(F.sequence(F.lit(1), F.lit(replicates)), draw), lambda u: _poisson1(u).cast("byte"))


def _poisson1(u: Column) -> Column:
    cnt = F.lit(0)
    for t in poisson1_thresholds():
        cnt = cnt + F.when(u >= F.lit(t), 1).otherwise(0)
    return cnt


def bootstrap_ci(reps: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Percentile interval over replicates (bounded by the replicate count, exact ``percentile``)."""
    a = (1.0 - level) / 2.0
    out = []
    for m in ("rd", "rr", "r1", "r0"):
        out += [F.percentile(col(m), a).alias(f"{m}_lo"), F.percentile(col(m), 1.0 - a).alias(f"{m}_hi")]
    return reps.groupBy(*by).agg(F.count(F.lit(1)).alias("replicates"), *out)
