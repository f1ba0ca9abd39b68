"""the refitted bootstrap makes what a patient's rows share once, and its sums stay those of single rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import irls
from trialspark.operators import replicates as R

SF = "/root/testdata/sf0.001"


def _sequences(seed=3, patients=30, outcomes=2, reps=7, late_start=False):
    rng = np.random.default_rng(seed)
    outcome, label, time, run, owner, design = [], [], [], [], [], []
    for p in range(patients):
        for o in range(outcomes):
            begin, size = (int(rng.integers(0, 3)) if late_start else 0), int(rng.integers(1, 24))
            for t in range(begin, begin + size):
                if not design or t == begin or (late_start and rng.random() < 0.1):  # covariates that change inside a patient
                    design.append([1.0, rng.normal(), 0.0, 0.0, float(rng.integers(0, 2))])
                outcome.append(o)
                label.append(float(t == begin + size - 1 and p % 2))
                time.append(t)
                run.append(len(design) - 1)
                owner.append(p)
    weight = rng.poisson(1.0, (patients, reps)).astype(float)
    return irls.Sequences(np.array(outcome), np.array(label), np.array(time), np.array(run), np.array(owner), np.array(design), weight)


@pytest.mark.parametrize("late_start", [False, True])
@pytest.mark.parametrize("scale", [0.0, 0.3, 9.0, 200.0])
def test_sums_of_sequences_equal_those_of_single_rows(scale, late_start):
    """Also where the predictor is clamped, times differ inside a block and only some models still move."""
    some, rng = _sequences(late_start=late_start), np.random.default_rng(5)
    beta = rng.normal(scale=scale, size=(2, 7, 5)) * np.array([1, 1, 0.1, 0.01, 1])
    moving = np.ones((2, 7), bool)
    moving[1, [0, 4]] = False
    varying = {2: 1, 3: 2}
    x = some.design[some.run]
    for column, power in varying.items():
        x[:, column] = some.time.astype(float) ** power
    want = irls.chunk_sums(iter([(some.outcome, some.label, x, some.weight[some.owner])]), beta, moving)
    got = irls.sequence_sums(varying)(iter([some, some]), beta, moving)
    assert got.keys() == want.keys()
    for o in want:
        near = 1e-9 if scale < 1 else 1e-4  # at the clamp 1 - mu of single rows has but three digits
        assert np.allclose(got[o], 2 * want[o], rtol=near, atol=1e-8)


def test_counts_are_merged_and_stay_whole(monkeypatch):
    monkeypatch.setattr(R, "MERGED", 10)
    rng, found, want = np.random.default_rng(1), R.Counts(), {}
    for _ in range(20):
        code, n = rng.integers(0, 30, 8), rng.random(8)
        found.add(code, n)
        for c, x in zip(code.tolist(), n.tolist()):
            want[c] = want.get(c, 0.0) + x
    found.merge()
    assert dict(zip(found.code.tolist(), found.n.tolist())) == pytest.approx(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_a_patients_covariates_are_stored_once_an_outcome(spark):
    from trialspark.plans import analysis as A
    from trialspark.plans import registry as Q

    prep = Q._prepared(spark, SF)
    ids = [r[0] for r in prep.select("outcome_id").distinct().collect()]
    patients = A.refit_patients(prep, Q.PARAMS, A.design(prep, ids), 3, 1)
    fit = prep.where("at_risk = 1 and complete")
    rows, given = patients.select(F.inline("rows")).agg(F.count("fit"), F.count("x")).first()
    assert rows >= fit.count() > given == fit.select("alf", "outcome_id").distinct().count()  # it was one a row
