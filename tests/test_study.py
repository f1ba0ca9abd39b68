"""The whole study through the public entry point, on sources stored as parquet folders."""

import dataclasses
import hashlib
import os
import tempfile

import pytest

from trialspark.params import FIXTURE_PARAMS
from trialspark.plans import study
from trialspark.sources import fixture_catalog, parquet_catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_run_from_parquet_sources(spark):
    root = tempfile.mkdtemp(prefix="trialspark-sources-")
    cat = fixture_catalog(spark, SF, FIXTURE_PARAMS)
    for f in dataclasses.fields(cat):
        getattr(cat, f.name).write.parquet(f"{root}/{f.name}")
    stored = parquet_catalog(spark, root)
    out = tempfile.mkdtemp(prefix="trialspark-out-")
    res = study.run(stored, FIXTURE_PARAMS, out_dir=out)
    eff = {r.outcome_id: r for r in res.effects.collect()}
    assert set(eff) <= {1, 2, 3, 4, 5, 6}
    for r in eff.values():
        assert r.r1 is None or -1e-12 <= r.r1 <= 1 + 1e-12
    assert len(res.outcomes.columns) == 57
    assert os.path.isdir(f"{out}/outcome_tables/outcome_id=1")
    assert spark.read.parquet(f"{out}/outcome_tables").count() == res.outcomes.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_bootstrap_refit_runs_and_orders_bounds(spark):
    from pyspark.sql import functions as F

    from trialspark.plans import analysis as A
    from trialspark.plans import registry as R
    from trialspark.plans.session import cut
    prep = cut(A.prepared(R.QUERIES["all_outcomes"](spark, SF), FIXTURE_PARAMS))
    ci = A.bootstrap_refit(prep, FIXTURE_PARAMS, [1, 5], replicates=2, seed=3, materialise=cut)
    rows = ci.collect()
    assert {r.outcome_id for r in rows} <= {1, 5}
    for r in rows:
        assert r.replicates == 2
        assert r.rd_lo is None or r.rd_lo <= r.rd_hi + 1e-12
    assert F is not None


def test_registered_bootstraps_run_the_replicates_of_the_study(spark):
    from trialspark.operators import survival as S
    from trialspark.params import StudyParams
    from trialspark.plans import registry as R
    assert R.BOOTSTRAP_REPLICATES == StudyParams().bootstrap_replicates == 200
    assert R.REFIT_REPLICATES == StudyParams().refit_replicates == 200
    patients = spark.range(40).withColumnRenamed("id", "alf")
    arrays = {r.alf: r.mults for r in patients.select("alf", S.multiplicities(patients.alf, 30, 7).alias("mults")).collect()}
    cdf = S.poisson1_thresholds()
    for alf, row in arrays.items():
        for rep, m in enumerate(row, 1):
            u = int(hashlib.md5(f"{alf}:{rep}:7".encode()).hexdigest()[:8], 16) / 2 ** 32
            assert m == sum(u >= t for t in cdf)
