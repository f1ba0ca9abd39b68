"""Sources stored by patient, lines dealt by their number, buckets that another session learns anew."""

import os

import pytest

from trialspark.operators import joins as J
from trialspark.params import FIXTURE_PARAMS
from trialspark.plans import registry as R
from trialspark.plans import trial as T
from trialspark.plans.cuts import Cuts, table_name
from trialspark.sources import fixtures

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_their_number_and_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "LINE_ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    tests = fixtures.fixture_catalog(spark, SF, FIXTURE_PARAMS).urine_tests
    found = J.duplicate_keys(tests, ["alf_pe", "spcm_collected_dt", "report_seq", "request_seq"])
    assert found.rdd.getNumPartitions() >= lines // 500


def test_baseline_reads_its_patients_orders_where_they_are(spark):
    cat, pre = R._pre(spark, SF)
    base = T.eligible_base(R._cat(spark, SF), FIXTURE_PARAMS).select("alf_pe")
    want = fixtures.raw_orders(spark, SF).join(base, "alf_pe", "left_semi")
    assert cat.spell.count() == want.count() < fixtures.raw_orders(spark, SF).count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        days = cat.gp_events.select("alf_pe", "event_dt").distinct().join(pre.select("alf_pe", "diag_date"), "alf_pe")
        assert "Exchange" not in _plan(days.groupBy("alf_pe").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_baseline_of_a_stored_base_equals_the_baseline_of_all_sources(spark):
    cat, pre = R._pre(spark, SF)
    plain = T.baseline_cohort(R._cat(spark, SF), FIXTURE_PARAMS)
    assert sorted(map(repr, pre.collect())) == sorted(map(repr, plain.select(*pre.columns).collect()))


def test_prescriptions_read_the_orders_once(spark):
    assert _plan(fixtures.fixture_catalog(spark, SF, FIXTURE_PARAMS).prescriptions).count("FileScan") == 1


def test_buckets_are_learnt_anew_and_dropped_with_the_cut(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id % 37 as string) as alf_pe", "id", "date'2020-01-01' as d", "decimal(id) as n")
    cuts = Cuts(spark, str(tmp_path))
    stored = cuts.table("t", lambda: rows, key="alf_pe", buckets=5)
    name = table_name(cuts.made["t"].path)
    spark.sql(f"DROP TABLE {name}")  # another session's catalog does not know it
    again = Cuts(spark, str(tmp_path)).table("t", lambda: 1 / 0, key="alf_pe", buckets=5)
    assert again.schema == stored.schema and "Exchange" not in _plan(again.groupBy("alf_pe").count())
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    cuts.drop("t")
    assert not spark.catalog.tableExists(name)
