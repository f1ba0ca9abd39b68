"""Stored intermediates (manifest, invalidation, deletion), outcome-wise sinks, late attachment, bucketed tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from trialspark.params import FIXTURE_PARAMS
from trialspark.plans import study
from trialspark.plans import trial as T
from trialspark.plans.cuts import Cuts, exists, fingerprint
from trialspark.sources import fixture_catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cuts_are_reused_until_their_input_changes(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("x", F.lit(len(built)))

    cuts = Cuts(spark, str(tmp_path / "cuts"))
    assert cuts.table("a", build, [source]).count() == 5
    first = cuts.made["a"].path
    assert cuts.table("a", build, [source]).count() == 5 and len(built) == 1
    assert Cuts(spark, str(tmp_path / "cuts")).table("a", build, [source]).count() == 5 and len(built) == 1  # another session
    spark.range(3).write.mode("append").parquet(source)  # changed input is not served stale
    assert cuts.table("a", build, [source]).count() == 8 and len(built) == 2
    assert not exists(spark, first)
    assert cuts.table("a", build, [source], version="b").first()["x"] == 3  # nor for other parameters
    paths = [c.path for c in cuts.made.values()]
    cuts.drop()
    assert not cuts.made and not any(exists(spark, p) for p in paths)
    assert Cuts(spark, str(tmp_path / "cuts")).made == {}


def test_an_unfinished_cut_is_built_again(spark, tmp_path):
    cuts = Cuts(spark, str(tmp_path))
    cuts.table("a", lambda: spark.range(4))
    os.remove(f"{cuts.made['a'].path}/_SUCCESS")
    assert cuts.table("a", lambda: spark.range(6)).count() == 6


def test_fingerprint_reads_the_listing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    one = fingerprint(spark, [path], "v")
    assert one == fingerprint(spark, [path], "v") != fingerprint(spark, [path], "w")
    spark.range(4).write.mode("overwrite").parquet(path)
    assert fingerprint(spark, [path], "v") != one


def test_a_rerun_of_one_outcome_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(12).select((F.col("id") % 3 + 1).cast("int").alias("outcome_id"), F.col("id").alias("v"))
    study.replace_outcomes(rows, path)
    study.replace_outcomes(rows, path)  # again: the same rows, not twice
    assert spark.read.parquet(path).count() == 12
    study.replace_outcomes(rows.where("outcome_id = 2").withColumn("v", F.col("v") + 100).limit(2), path)
    got = {r[0]: (r[1], r[2]) for r in spark.read.parquet(path).groupBy("outcome_id").agg(F.count("*"), F.min("v")).collect()}
    assert got == {1: (4, 0), 2: (2, 101), 3: (4, 2)}


@needs_data
def test_study_replaces_its_outcomes_and_releases_its_tables(spark, tmp_path):
    import dataclasses

    cat = fixture_catalog(spark, SF, FIXTURE_PARAMS)
    params = dataclasses.replace(FIXTURE_PARAMS, bootstrap_replicates=5)
    out = str(tmp_path / "out")
    both = study.run(cat, params, out_dir=out, outcome_ids=[3, 5], cuts_dir=str(tmp_path / "cuts"))
    def kept(name):
        return {r["outcome_id"]: None if name == "survival_curves" else r for r in spark.read.parquet(f"{out}/{name}").collect()}

    before = {n: kept(n) for n in ("effects", "survival_curves", "intervals")}
    curve = spark.read.parquet(f"{out}/survival_curves").count()
    one = study.run(cat, params, out_dir=out, outcome_ids=[5], cuts_dir=str(tmp_path / "cuts"))
    for name, rows in before.items():
        assert set(kept(name)) == set(rows) and kept(name).get(3) == rows.get(3)
    assert spark.read.parquet(f"{out}/survival_curves").count() == curve
    paths = [c.path for c in both.cuts.made.values()]
    assert len(paths) >= 5 and all(exists(spark, p) for p in paths)
    both.release()
    assert not any(exists(spark, p) for p in paths)
    assert one.outcomes.count() > 0  # the other run's tables stay
    one.release()


@needs_data
def test_sorted_rows_of_the_outcome_stage_hold_no_baseline_column(spark, tmp_path):
    cat = fixture_catalog(spark, SF, FIXTURE_PARAMS)
    cuts = Cuts(spark, str(tmp_path))
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    pre = cuts.once(T.baseline_cohort(cat, FIXTURE_PARAMS, materialise=cuts.once))
    table = T.all_outcomes(cat, FIXTURE_PARAMS, pre=pre, materialise=cuts.once)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "Generate " in line]
    assert windows
    # what the windows and explosions sit on: the narrowest projection below them has no baseline column
    for name in ("bmi_val", "dementia", "efi", "gp_presc_rt", "amr_baseline", "most_recent_urine"):
        assert not any(re.search(rf"\b{name}#", line) for line in windows), name
    scans = [line for line in plan.splitlines() if "Relation [" in line and "bmi_val" in line]
    assert scans  # attached after them


@needs_data
def test_bucketed_tables_join_without_an_exchange(spark):
    from trialspark.operators import events as E
    from trialspark.sources import store_bucketed, table_catalog

    cat = fixture_catalog(spark, SF, FIXTURE_PARAMS)
    tables = store_bucketed(cat, "trialspark_test", buckets=4)
    stored = table_catalog(spark, tables, normalise=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hierarchy = stored.diagnosis.join(stored.episode, ["prov_unit_cd", "spell_num_pe", "epi_num"]).join(stored.spell, ["prov_unit_cd", "spell_num_pe"])
        assert "Exchange" not in _plan(hierarchy) and "SortMergeJoin" in _plan(hierarchy)
        by_patient = stored.urine_tests.join(stored.cohort.select("alf_pe", "diag_date"), "alf_pe")
        assert "Exchange" not in _plan(by_patient)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pre = T.baseline_cohort(cat, FIXTURE_PARAMS, materialise=lambda df: df)
    plain = E.outcome_dates(cat, pre, FIXTURE_PARAMS, [1, 2]).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, E.outcome_dates(stored, pre, FIXTURE_PARAMS, [1, 2]).collect()))
    spark.sql("DROP DATABASE trialspark_test CASCADE")
