"""Run the whole study on a source catalog: outcome tables, weights, clones, effects.

Sinks: the outcome table is written as parquet partitioned by ``outcome_id``
(one folder per outcome, like the study's six tables), and so are the effect measures, their
intervals and the survival curves. A run replaces the outcomes it computed and no others.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame

from trialspark.operators import events as E
from trialspark.operators import survival as S
from trialspark.operators.bounds import index_bounds
from trialspark.params import StudyParams
from trialspark.plans import analysis as A
from trialspark.plans import trial as T
from trialspark.plans.cuts import Cuts
from trialspark.plans.session import ensure_checkpoint_dir
from trialspark.sources.catalog import SourceCatalog


@dataclasses.dataclass
class StudyResult:
    outcomes: DataFrame      # 56 study columns + outcome_id, one row per patient x outcome x interval
    clones: DataFrame        # weighted, censored clones with truncated weights
    curves: DataFrame        # weighted survival curve per (outcome_id, arm, cal_time)
    effects: DataFrame       # r1, r0, rd, rr, nnt per outcome
    intervals: DataFrame     # percentile intervals of the effects, weights held fixed
    fits: dict               # outcome_id -> (denominator, numerator) LogitFit
    cuts: Cuts               # the stored tables behind the frames above

    def release(self) -> None:
        """Delete the stored tables; the frames can't be read after it."""
        self.cuts.drop()


def replace_outcomes(df: DataFrame, path: str) -> None:
    """Write rows by ``outcome_id``: the outcomes in ``df`` are replaced, those of earlier runs stay.

    Running it again gives the same files' contents, and a run of one outcome leaves the others alone.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome_id").parquet(path)


def write_outcome_tables(outcomes: DataFrame, path: str) -> None:
    """Final sink: one parquet folder per outcome (``outcome_id=<k>``)."""
    replace_outcomes(outcomes, path)


def run(cat: SourceCatalog, params: StudyParams, out_dir: str | None = None, outcome_ids=None,
        check: bool = True, cuts_dir: str | None = None) -> StudyResult:
    """The study end to end. ``check`` first makes sure that merged sources have one row per key.

    Intermediates are stored under ``spark.checkpoint.dir`` (or ``cuts_dir``) while the result is in use;
    ``StudyResult.release`` deletes them. Each output is written by outcome, so a run of some outcomes
    replaces theirs only.
    """
    ids = sorted(outcome_ids or E.OUTCOMES)
    cuts = Cuts(cat.cohort.sparkSession, f"{cuts_dir or ensure_checkpoint_dir(cat.cohort.sparkSession)}/study-{uuid.uuid4().hex}")
    cut = cuts.once
    pre = cut(T.baseline_cohort(cat, params, materialise=cut, check=check), "baseline")
    outcomes = cut(T.all_outcomes(cat, params, outcome_ids=ids, pre=pre, bounds=index_bounds(pre), materialise=cut), "outcomes")
    prep = cut(A.prepared(outcomes, params, rows=outcomes.count()), "prepared")
    fits = A.fit_models(prep, ids)
    clones = cut(A.weighted_clones(A.with_fitted(prep, fits), params, materialise=cut), "clones")
    curves = S.weighted_km(clones, ["outcome_id", "arm"])
    effects = S.effect_measures(S.final_survival(curves, ["outcome_id", "arm"]), ["outcome_id"])
    intervals = A.bootstrap_fixed(clones, replicates=params.bootstrap_replicates)
    if out_dir:
        write_outcome_tables(outcomes, f"{out_dir}/outcome_tables")
        for name, df in (("survival_curves", curves), ("effects", effects), ("intervals", intervals)):
            replace_outcomes(df, f"{out_dir}/{name}")
    return StudyResult(outcomes, clones, curves, effects, intervals, fits, cuts)
