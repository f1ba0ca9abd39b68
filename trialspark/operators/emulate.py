"""Clone, censor, keep-until-censored, blank outcome.

The study applies an R function per patient over the treatment vector. Here
the first initiation position and the row count are window aggregates over
``(alf, outcome_id)`` and the censoring point is a closed form of them, so the
whole step is narrow on data partitioned by patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.params import StudyParams

col = F.col
PATIENT = ["alf", "outcome_id"]


def clone_arms(df: DataFrame) -> DataFrame:
    """Two copies of every row, ``arm`` 0 (no prophylaxis) and 1 (prophylaxis)."""
    return df.withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1))))


def _per_patient() -> Window:
    return Window.partitionBy(*PATIENT)


def position() -> Column:
    """1-based row position; rows of a patient are contiguous from ``cal_time`` 0."""
    return col("cal_time") + 1


def first_initiation(last_pos: int, treat: str = "pabx_start") -> Column:
    """First position in 2..``last_pos`` with treatment (NULL if none)."""
    pos = position()
    return F.min(F.when((col(treat) == 1) & (pos >= 2) & (pos <= last_pos), pos)).over(_per_patient())


def censor_no_treat(params: StudyParams, treat: str = "pabx_start") -> Column:
    """O40, arm 0: censor at the first initiation inside the grace period.

    As written (D16) positions 2-4 censor at the position, 5-12 one interval
    later and only if that row exists; as documented positions 2-13 censor at
    the position.
    """
    n = F.count(F.lit(1)).over(_per_patient())
    g = params.grace_weeks
    if params.documented:
        return first_initiation(g + 1, treat)
    f = first_initiation(g, treat)
    return F.when(f <= 4, f).when(f + 1 <= n, f + 1)


def censor_no_start(params: StudyParams, treat: str = "pabx_start") -> Column:
    """O41, arm 1: more than ``grace`` rows and no treatment in positions 2..grace+1 -> censor at grace+1."""
    w = _per_patient()
    g = params.grace_weeks
    pos = position()
    n = F.count(F.lit(1)).over(w)
    started = F.max(F.when((pos >= 2) & (pos <= g + 1), col(treat))).over(w)
    return F.when((n > g) & (started == 0), F.lit(g + 1))


def censor_clones(df: DataFrame, params: StudyParams, treat: str = "pabx_start",
                  outcome: str = "outcome") -> DataFrame:
    """Clone, set the censoring position per arm, keep rows up to and including it,
    blank the outcome on the censored row. Adds ``arm``, ``censor_pos``, ``my_censor``."""
    df = df.withColumns({"_c0": censor_no_treat(params, treat), "_c1": censor_no_start(params, treat)})
    df = clone_arms(df)
    df = df.withColumn("censor_pos", F.when(col("arm") == 0, col("_c0")).otherwise(col("_c1"))).drop("_c0", "_c1")
    pos = position()
    kept = df.where(col("censor_pos").isNull() | (pos <= col("censor_pos")))          # O42
    cens = F.when(pos == col("censor_pos"), 1).otherwise(0)
    return (kept.withColumn("my_censor", cens)
            .withColumn(outcome, F.when(col("my_censor") == 1, F.lit(None)).otherwise(col(outcome))))  # O43
