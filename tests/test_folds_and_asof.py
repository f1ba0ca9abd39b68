"""One fold over the tests, one pass over the hospital tables, date bounds, as-of joins, checked joins."""

import dataclasses
import datetime as dt
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from trialspark.functions.predicates import any_resistant
from trialspark.operators import cohort as C
from trialspark.operators import events as E
from trialspark.operators import outcomes as O
from trialspark.operators.asof import Source, asof_join
from trialspark.operators.bounds import index_bounds
from trialspark.operators.joins import checked_left_join
from trialspark.params import AS_DOCUMENTED, FIXTURE_PARAMS, StudyParams
from trialspark.plans import trial as T
from trialspark.sources import fixture_catalog, parquet_catalog

D = dt.date
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df, folder):
    """Scans of a stored source in the plan, without those a reused exchange stands for."""
    return len(re.findall(rf"FileScan parquet.*Location: [^\n]*/{folder}\]", _plan(df)))


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="trialspark-fold-")
    cat = fixture_catalog(spark, SF, FIXTURE_PARAMS)
    for f in dataclasses.fields(cat):
        getattr(cat, f.name).write.parquet(f"{root}/{f.name}")
    return parquet_catalog(spark, root)


# ---------------------------------------------------------------- plans of uncut builders
@needs_data
def test_uncut_plans_read_each_event_source_once(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    pre = T.baseline_cohort(stored, FIXTURE_PARAMS, materialise=lambda df: df)
    assert _scans(pre, "urine_tests") == 1
    assert _scans(pre, "gp_events") == 1
    for op in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython"):
        assert op not in _plan(pre)
    table = T.all_outcomes(stored, FIXTURE_PARAMS, pre=_stored(spark, pre), materialise=lambda df: _stored(spark, df))
    assert _scans(table, "diagnosis") == _scans(table, "episode") == 1
    assert _scans(table, "spell") == 0 and _scans(table, "urine_tests") == 0  # the stored spells, the stored baseline


def _stored(spark, df):
    path = tempfile.mkdtemp(prefix="trialspark-cut-") + "/t"
    df.write.parquet(path)
    return spark.read.parquet(path)


@needs_data
def test_date_bounds_reach_the_scans(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    keys = stored.cohort.select("alf_pe", "diag_date").withColumn("pabx_end", F.lit(None).cast("date"))
    near = index_bounds(keys)
    year = near.first.replace(year=near.first.year - 1).isoformat()
    p = FIXTURE_PARAMS
    cases = {
        "gp_events": (C.contact_days(keys, stored.gp_events, p, near), "event_dt", f"LessThanOrEqual(event_dt,{near.last.replace(year=near.last.year + 1)}"),
        "urine_tests": (C.baseline_resistance(keys, stored.urine_tests, p, near), "spcm_collected_dt", f"LessThanOrEqual(spcm_collected_dt,{near.last})"),
        "gp_uti": (C.baseline_uti_counts_gp(keys, stored.gp_uti, stored.hosp_uti, p, near), "event_str_dt", f"GreaterThanOrEqual(event_str_dt,{year})"),
        "hosp_uti": (C.baseline_uti_counts_hosp(keys, stored.hosp_uti, p, near), "event_end_dt", f"GreaterThanOrEqual(event_end_dt,{year})"),
        "all_uti": (O.next_event_date(keys, stored.all_uti, near), "event_str_dt", "GreaterThanOrEqual(event_str_dt,"),
    }
    for folder, (df, column, pushed) in cases.items():
        line = next(x for x in _plan(df).splitlines() if "FileScan" in x and f"/{folder}]" in x)
        filters = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line).group(1)
        assert pushed in filters and column in filters, (folder, filters)
    fold = E.lab_fold(keys, stored.urine_tests, p, near)
    line = next(x for x in _plan(fold).splitlines() if "FileScan" in x and "/urine_tests]" in x)
    assert "GreaterThanOrEqual(spcm_collected_dt," in line
    assert _plan(fold).count("Exchange hashpartitioning") <= 2  # the tests and the keys, by patient
    plain = C.contact_days(keys, stored.gp_events, p)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cases["gp_events"][0].collect()))


# ---------------------------------------------------------------- the folds against the single operators
DRUGS = ["trimethoprim", "nitrofurantoin", "amoxicillin", "coamoxiclav", "cephalexin", "pivmecillinam", "fosfomycin", "ciprofloxacin",
         "amoxicillin_clavulanate", "gentamicin"]


def _tests(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(700):
        day = D(2016, 6, 1) + dt.timedelta(days=rnd.choice([0, 0, 1, -1, -365, -366, 365, rnd.randint(-500, 400)]))
        rows.append((rnd.choice("abcdefgh"), rnd.choice([day, day, day, None]), rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, None]),
                     *[rnd.choice(["Resistant", "Sensitive", "Sensitive", None]) if rnd.random() < 0.3 else "Sensitive" for _ in DRUGS],
                     rnd.choice(["x", None, *__import__("trialspark.functions.codes", fromlist=["x"]).UTI_OUTCOME_RANK])))
    kind = "alf_pe string, spcm_collected_dt date, report_seq long, request_seq long, " + ", ".join(f"{d} string" for d in DRUGS) + ", uti_outcome string"
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize(("mode", "drugs"), [("as_written", None), (AS_DOCUMENTED, None), ("as_written", ("nitrofurantoin", "fosfomycin"))])
def test_lab_fold_equals_the_single_operators(spark, mode, drugs):
    params = StudyParams(mode=mode, **({"antibiotics": drugs} if drugs else {}))
    tests = _tests(spark, 3)
    keys = spark.createDataFrame([(p, D(2016, 6, 1) + dt.timedelta(days=i)) for i, p in enumerate("abcdefgz")], "alf_pe string, diag_date date")
    near = index_bounds(keys)
    got = {r.alf_pe: r for r in E.lab_fold(keys, tests, params, near).collect()}
    assert set(got) <= set("abcdefg")
    want = {"amr_baseline": C.baseline_resistance(keys, tests, params), "most_recent_urine": O.closest_specimen(keys, tests, params)}
    for k, pred in {3: any_resistant(params.antibiotics), 5: F.col("trimethoprim") == "Resistant", 6: F.col("nitrofurantoin") == "Resistant"}.items():
        want[f"od_{k}"] = E.first_event(E.lab_events(keys, tests, pred), "spcm_collected_dt")
    want["od_4"] = E.first_event(E.multi_resistant_events(keys, tests, params), "spcm_collected_dt")
    for name, df in want.items():
        rows = {r[0]: r[1] for r in df.collect() if r[1] is not None}
        assert {k: r[name] for k, r in got.items() if r[name] is not None} == rows, name
        assert rows or name == "od_5"


@pytest.mark.parametrize("mode", ["as_written", AS_DOCUMENTED])
def test_hospital_pass_equals_the_single_operators(spark, mode):
    params = StudyParams(mode=mode)
    rnd = random.Random(5)
    spells = [(rnd.choice("abcd"), str(n % 3), n, D(2017, 1, 1) + dt.timedelta(days=rnd.randint(0, 60))) for n in range(60)]
    spell = spark.createDataFrame([(a, u, n, s, s + dt.timedelta(days=rnd.randint(0, 5)) if n % 9 else None) for a, u, n, s in spells],
                                  "alf_pe string, prov_unit_cd string, spell_num_pe long, admis_dt date, disch_dt date")
    epis = [(u, n, e, s + dt.timedelta(days=rnd.randint(0, 3))) for _, u, n, s in spells for e in (1, 2)]
    episode = spark.createDataFrame([(*e, e[3]) for e in epis], "prov_unit_cd string, spell_num_pe long, epi_num int, epi_str_dt date, epi_end_dt date")
    diagnosis = spark.createDataFrame([(u, n, e, rnd.choice(["U820", "N390", "Z000", "U899", "N390"])) for u, n, e, _ in epis for _ in (1, 2)],
                                      "prov_unit_cd string, spell_num_pe long, epi_num int, diag_cd_1234 string")
    cohort = spark.createDataFrame([(p, D(2016, 12, 20)) for p in "abc"], "alf_pe string, diag_date date")
    got = {r.alf_pe: (r.od_1, r.od_2) for r in E.hospital_dates(diagnosis, episode, spell, cohort, params).collect()}
    code = F.col("diag_cd_1234")
    res = E.hospital_events(diagnosis, episode, spell, cohort, E.resistance_code(code), params)
    both = E.co_occurring(E.hospital_events(diagnosis, episode, spell, cohort, E.uti_code(code), params), res, params)
    for i, events in enumerate((res, both)):
        want = {r[0]: r[1] for r in E.first_event(E.exclude_recent_discharge(events, spell, params), "epi_str_dt").collect()}
        assert {k: v[i] for k, v in got.items() if v[i]} == want and want


# ---------------------------------------------------------------- as-of
def _plain_asof(rows, events, backward, exact):
    out = []
    for key, t in rows:
        near = [(e, r) for k, e, r in events if k == key and k is not None and e is not None and t is not None
                and ((e < t) if backward else (e > t) or False) | (exact and e == t)]
        if not near:
            out.append((key, t, None, None))
            continue
        day = max(e for e, _ in near) if backward else min(e for e, _ in near)
        best = min((r for e, r in near if e == day), key=lambda r: (r is None, r or 0))
        out.append((key, t, day, best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_join_equals_its_definition(spark, backward, exact):
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(12)])) for _ in range(120)]
    events = [(rnd.choice(["a", "b", "d", None]), rnd.choice([None, *range(12)]), rnd.choice([None, 1, 2, 3])) for _ in range(40)]
    left = spark.createDataFrame(rows, "k string, t int")
    right = spark.createDataFrame(events, "k string, u int, r int")
    other = Source(right, "u", {"w": "u"}, backward=not backward)
    out = asof_join(left, "k", "t", Source(right, "u", {"u": "u", "r": "r"}, backward, exact, prefer="r"), other)
    assert _plan(out).count("Exchange hashpartitioning") == 1  # rows and both sources
    got = out.collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == _plain_asof(rows, events, backward, exact)
    assert sorted([(r.k, r.t, r.w) for r in got], key=repr) == [x[:3] for x in _plain_asof(rows, events, not backward, True)]
    with pytest.raises(ValueError, match="in the rows already"):
        asof_join(left, "k", "t", Source(right, "u", {"t": "u"}))


# ---------------------------------------------------------------- checked joins
def _people(spark):
    return spark.createDataFrame([("a", D(2016, 6, 1), None), ("b", D(2016, 6, 1), 3), (None, None, 1)], "alf_pe string, diag_date date, ethnic int")


def test_a_second_match_fails_wherever_the_column_goes(spark):
    left = _people(spark)
    right = spark.createDataFrame([("a", 1), ("z", 5), ("z", 6), (None, 7), (None, 8)], "alf_pe string, v int")
    out = checked_left_join(left, right, "alf_pe", "lookup")
    assert {r.alf_pe: r.v for r in out.collect()} == {"a": 1, "b": None, None: None}
    twice = right.union(right.where("alf_pe = 'a'"))  # an equal row is a second match too
    with pytest.raises(Exception, match="CardinalityError: lookup: more than one row for a"):
        checked_left_join(left, twice, "alf_pe", "lookup").select("alf_pe").collect()


def test_each_merged_source_raises_on_a_duplicate(spark):
    cohort = _people(spark).where("alf_pe is not null").withColumns({
        "wob": F.lit(D(1950, 1, 1)), "gp_end_date": F.lit(D(2019, 1, 1)), "pabx_str": F.lit(D(2016, 7, 1))})
    death = ("alf_pe string, death_dt date", [("a", D(2017, 1, 1)), ("a", D(2017, 2, 1))])
    with pytest.raises(Exception, match="CardinalityError: deaths"):
        C.follow_up_exit(cohort, spark.createDataFrame(death[1], death[0]), StudyParams()).collect()
    lookup = spark.createDataFrame([("b", 1), ("b", 1)], "alf_pe string, code int")
    with pytest.raises(Exception, match="CardinalityError: lookup of ethnic"):
        C.fill_from(cohort, lookup, "ethnic", "code").collect()
    bounds = spark.createDataFrame([("a", D(2016, 7, 1), D(2016, 7, 1), D(2016, 8, 1)), ("a", D(2016, 7, 1), D(2016, 7, 2), D(2016, 9, 1))],
                                   "alf_pe string, pabx_str date, first_script date, last_end date")
    with pytest.raises(Exception, match="CardinalityError: episode bounds"):
        C.exposure_bounds(cohort, bounds).collect()
    kind = "alf_pe string, pabx_str date, alt_abx_type string"
    for pair in (("x", "y"), ("x", None)):
        starts = spark.createDataFrame([("a", D(2016, 7, 1), t) for t in pair], kind)
        with pytest.raises(Exception, match="CardinalityError: exposure type"):
            O.exposure_type(cohort, starts, StudyParams()).collect()
    fine = spark.createDataFrame([("a", D(2016, 7, 1), "x"), ("a", D(2016, 7, 1), "x"), ("a", D(2016, 8, 1), "y"), ("a", D(2016, 8, 1), "z")], kind)
    assert [tuple(r) for r in O.exposure_type(cohort, fine, StudyParams()).collect()] == [("a", "x")]


@needs_data
def test_duplicates_stop_the_study_without_the_checks(spark, stored):
    """check=False: the joins themselves refuse a second death or ethnicity."""
    some = T.exit_cohort(stored, FIXTURE_PARAMS).where("dod is not null").select("alf_pe").limit(1)
    again = dataclasses.replace(stored, deaths=stored.deaths.unionByName(stored.deaths.join(some, "alf_pe")))
    with pytest.raises(Exception, match="CardinalityError: deaths"):
        T.baseline_cohort(again, FIXTURE_PARAMS, check=False).collect()
