"""Named queries over the driver's tables: one per operator group of the study.

Each builder takes ``(spark, sf_dir)``, binds the fixture sources and returns a
DataFrame with explicitly named and typed columns.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import cohort as C
from trialspark.operators import emulate as M
from trialspark.operators import events as E
from trialspark.operators import joins as J
from trialspark.operators import outcomes as O
from trialspark.operators import panel as P
from trialspark.operators import survival as S
from trialspark.operators import weights as W
from trialspark.functions.predicates import any_resistant, resistant_to
from trialspark.operators.bounds import index_bounds
from trialspark.params import AS_DOCUMENTED, FIXTURE_PARAMS
from trialspark.plans import analysis as A
from trialspark.plans import trial as T
from trialspark.plans.cuts import Cuts
from trialspark.plans.session import cut, ensure_checkpoint_dir
from trialspark.sources.fixtures import fixture_catalog, line_partitions, raw_lines, raw_orders

col = F.col
PARAMS = FIXTURE_PARAMS
#: The stated intent instead of the code, wherever they differ.
DOCUMENTED = dataclasses.replace(PARAMS, mode=AS_DOCUMENTED)
#: A denominator model of three terms, small enough for SQL to solve.
SMALL_MODEL = (["cal_time", "ruti_age"], [])
ROUND = 9
BOOTSTRAP_REPLICATES = PARAMS.bootstrap_replicates
BOOTSTRAP_SEED = 7
REFIT_REPLICATES = PARAMS.refit_replicates


_CATALOGS: dict = {}


def _cat(spark: SparkSession, sf_dir: str):
    """The fixture sources, bound once per (session, folder): lazy frames, no data held."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = fixture_catalog(spark, sf_dir, PARAMS)
    return _CATALOGS[key]


#: The driver's tables that the sources are made of.
SOURCE_TABLES = ("customer", "lineitem", "orders", "supplier")
_CUTS: dict = {}


def _memo(spark, sf_dir, name, build, params=PARAMS, **layout):
    """A reused intermediate, stored until the folder's files (or the parameters) change."""
    app = spark.sparkContext.applicationId
    if app not in _CUTS:
        _CUTS[app] = Cuts(spark, f"{ensure_checkpoint_dir(spark)}/registry-{app}")
    folder = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    return _CUTS[app].table(f"{name}-{folder}", build, [f"{sf_dir}/{t}.parquet" for t in SOURCE_TABLES], repr(params), **layout)


#: Orders in a bucket of the tables stored by patient.
BUCKET_ROWS = 1 << 18


def _layout(spark, sf_dir):
    """Buckets by patient, as many as the orders need (one a core at least); the count reads footers only."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return {"key": "alf_pe", "buckets": max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))}


def _baseline(spark, sf_dir, name, params):
    """The baseline, and the sources over the orders and lines of its patients alone.

    All orders are moved to their patients once, before the eligible base, which reads them several times.
    Nothing below the base reads another patient's events: its patients' orders are picked where they are, and
    the lines of these orders are picked and stored by order, once for tests, episodes and diagnoses.
    """
    layout = _layout(spark, sf_dir)
    everyone = _memo(spark, sf_dir, "orders", lambda: raw_orders(spark, sf_dir), **layout)
    all_of_them = fixture_catalog(spark, sf_dir, PARAMS, everyone)
    exits = _memo(spark, sf_dir, f"exits-{name}", lambda: T.exit_cohort(all_of_them, params), params, **layout)
    base = _memo(spark, sf_dir, f"base-{name}", lambda: T.eligible_base(all_of_them, params, exits), params, **layout)
    theirs = lambda: everyone.join(base.select("alf_pe"), "alf_pe", "left_semi")
    orders = _memo(spark, sf_dir, f"orders-{name}", theirs, params, **layout)
    all_lines = raw_lines(spark, sf_dir)
    of_theirs = lambda: all_lines.join(orders.select(col("o_orderkey").alias("l_orderkey")).hint("shuffle_hash"), "l_orderkey", "left_semi")
    lines = _memo(spark, sf_dir, f"lines-{name}", of_theirs, params, key="l_orderkey", buckets=line_partitions(all_lines))
    cat = fixture_catalog(spark, sf_dir, PARAMS, orders, lines)
    return cat, _memo(spark, sf_dir, name, lambda: T.baseline_cohort(cat, params, base=base), params, **layout)


def _pre(spark, sf_dir):
    return _baseline(spark, sf_dir, "pre", PARAMS)


def _table(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return _memo(spark, sf_dir, "outcomes", lambda: T.all_outcomes(cat, PARAMS, pre=pre, bounds=index_bounds(pre), materialise=cut))


def _analysis(spark, sf_dir, name, baseline, params):
    """The analysis rows of the outcome table, stored by patient as the panel leaves them; windows read them where they are.

    Only the columns that the analysis reads are made and stored; what follows from a row alone is made anew by its readers.
    """
    cat, pre = baseline
    ids = sorted(E.OUTCOMES)
    buckets = T.panel_buckets(spark, pre.count(), len(ids), params)
    build = lambda: T.all_outcomes(cat, params, ids, pre, index_bounds(pre), cut, buckets).select(*A.ANALYSIS_COLUMNS)
    return A.prepared(_memo(spark, sf_dir, name, build, params, key="alf", buckets=buckets, dealt=True), params)


def _prepared(spark, sf_dir):
    return _analysis(spark, sf_dir, "analysis", _pre(spark, sf_dir), PARAMS)


def _prepared_documented(spark, sf_dir):
    return _analysis(spark, sf_dir, "analysis-documented", _pre_documented(spark, sf_dir), DOCUMENTED)


def _pre_cols(*cols) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark, sf_dir):
        return _pre(spark, sf_dir)[1].select("alf_pe", *cols)
    return q


# ---------------------------------------------------------------- baseline
def cohort_exit(spark, sf_dir):
    return T.exit_cohort(_cat(spark, sf_dir), PARAMS).select(
        "alf_pe", "diag_date", "dod", "cohort_end_dt", "cohort_end_reason")


def prior_exposure_excluded(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    ex = T.exit_cohort(cat, PARAMS)
    kept = C.exclude_prior_exposure(ex, cat.exposure_ends, PARAMS)
    return ex.join(kept.select("alf_pe"), "alf_pe", "left_anti").select("alf_pe")


# ---------------------------------------------------------------- panel
def _panel(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return P.panel(pre, PARAMS)


def interval_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select("alf_pe", "cal_time", "cal_dt")


def exposure_flags(spark, sf_dir):
    return _panel(spark, sf_dir).select("alf_pe", "cal_time", "pabx", "all_pabx")


def exit_flags(spark, sf_dir):
    return _panel(spark, sf_dir).select("alf_pe", "cal_time", "death", "ltf", "study_ended", "new_pabx",
                                        "diag_12months")


# ---------------------------------------------------------------- events
_EV = ["alf_pe", "prov_unit_cd", "spell_num_pe", "epi_num", "epi_str_dt", "diag_cd_1234"]


def hospital_events(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return E.hospital_resistance_events(cat, pre, PARAMS).select(*_EV)


def recent_discharge(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return E.exclude_recent_discharge(E.hospital_resistance_events(cat, pre, PARAMS), cat.spell, PARAMS).select(*_EV)


def _co_occurring(baseline, params):
    """The hierarchy is joined once for both code sets, and its few events are stored."""
    cat, pre = baseline
    code = col("diag_cd_1234")
    both = cut(E.hospital_events(cat.diagnosis, cat.episode, cat.spell, pre, E.resistance_code(code) | E.uti_code(code), params))
    together = E.co_occurring(both.where(E.uti_code(code)), both.where(E.resistance_code(code)), params)
    return E.exclude_recent_discharge(together, cat.spell, params).select(*_EV).distinct()


def co_occurring(spark, sf_dir):
    return _co_occurring(_pre(spark, sf_dir), PARAMS)


def _lab(pred):
    def q(spark, sf_dir):
        cat = _cat(spark, sf_dir)
        return E.lab_events(cat.cohort, cat.urine_tests, pred()).select(
            "alf_pe", "spcm_collected_dt", "report_seq", "request_seq")
    return q


def lab_multi(spark, sf_dir):
    cat = _cat(spark, sf_dir)
    return E.multi_resistant_events(cat.cohort, cat.urine_tests, PARAMS).select(
        "alf_pe", "spcm_collected_dt", "report_seq", "request_seq", col("resistant_count").cast("int"))


def first_event(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return E.outcome_dates_long(E.outcome_dates(cat, pre, PARAMS, sorted(E.OUTCOMES))).select(
        "alf_pe", col("outcome_id").cast("int"), "outcome_dt")


# ---------------------------------------------------------------- outcome template stages
def _stacked(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    facts = T.patient_facts(pre, cat, PARAMS, exclude=False)
    ids = sorted(E.OUTCOMES)
    wide = T.missing_dates(cat, pre, PARAMS, ids)
    return T.stacked_panel(facts, wide, PARAMS, ids, pre.count())


def outcome_flag(spark, sf_dir):
    df = _stacked(spark, sf_dir).withColumn("outcome", O.outcome_flag(PARAMS))
    return df.select("alf_pe", col("outcome_id").cast("int"), "cal_time", col("outcome").cast("int"))


def competing_events(spark, sf_dir):
    df = O.resolve_competing(_stacked(spark, sf_dir).withColumn("outcome", O.outcome_flag(PARAMS)), PARAMS)
    return df.select("alf_pe", col("outcome_id").cast("int"), "cal_time", "death", "ltf", "study_ended",
                     "diag_12months", "new_pabx", col("outcome").cast("int"))


def _template(spark, sf_dir):
    return T.outcome_template(_stacked(spark, sf_dir), PARAMS)


def trimmed_panel(spark, sf_dir):
    return _template(spark, sf_dir).select("alf_pe", col("outcome_id").cast("int"), "cal_time", "cal_dt")


def inclusion_days(spark, sf_dir):
    return _template(spark, sf_dir).select("alf_pe", col("outcome_id").cast("int"), "fup_obs").distinct()


def death_after_outcome(spark, sf_dir):
    return _template(spark, sf_dir).select("alf_pe", col("outcome_id").cast("int"),
                                           col("death_after_outcome").cast("int")).distinct()


def closest_specimen(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return O.closest_specimen(pre, cat.urine_tests, PARAMS)


def exposure_type(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return O.exposure_type(pre, cat.exposure_starts, PARAMS)


def clamped_exposure(spark, sf_dir):
    return O.clamp_exposure(_pre(spark, sf_dir)[1]).select(
        "alf_pe", "pabx_str_c", "pabx_end_c", "pabx_duration", "pabx_str_all_c", "pabx_end_all_c",
        "pabx_duration_all")


def next_event(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return O.next_event_date(pre, cat.all_uti)


def started_before_index(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return O.started_before_index(O.clamp_exposure(pre), cat.exposure_starts)


def unique_key_check(spark, sf_dir):
    return J.duplicate_keys(_cat(spark, sf_dir).urine_tests,
                            ["alf_pe", "spcm_collected_dt", "report_seq", "request_seq"])


def outcome_table(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return T.all_outcomes(cat, PARAMS, outcome_ids=[1], pre=pre, materialise=cut)


def all_outcomes(spark, sf_dir):
    cat, pre = _pre(spark, sf_dir)
    return T.all_outcomes(cat, PARAMS, pre=pre, bounds=index_bounds(pre), materialise=cut)


# ---------------------------------------------------------------- analysis
def _clones(spark, sf_dir, weights: bool):
    prep = _prepared(spark, sf_dir)
    if weights:
        prep = A.with_probabilities(prep, *A.formula_probabilities())
    return prep


def clones_censored(spark, sf_dir):
    df = M.censor_clones(_clones(spark, sf_dir, False), PARAMS)
    return df.select("alf", "outcome_id", col("arm").cast("int"), "cal_time", col("censor_pos").cast("int"),
                     col("my_censor").cast("int"), col("outcome").cast("int"), "pabx_start")


def _weighted(spark, sf_dir):
    store = lambda clones: _memo(spark, sf_dir, "clones", lambda: clones)
    return A.weighted_clones(_clones(spark, sf_dir, True), PARAMS, materialise=store, narrow=True)


def weights_given_probs(spark, sf_dir):
    return _weighted(spark, sf_dir).select(
        "alf", "outcome_id", col("arm").cast("int"), "cal_time", F.round("sw_a", ROUND).alias("sw_a"),
        F.round("sw_trunc", ROUND).alias("sw_trunc"))


def weighted_km(spark, sf_dir):
    curve = S.weighted_km(_weighted(spark, sf_dir), ["outcome_id", "arm"])
    return curve.select("outcome_id", col("arm").cast("int"), "cal_time",
                        *[F.round(c, ROUND).alias(c) for c in ("n_risk", "n_event", "surv")])


def effects(spark, sf_dir):
    eff = A.effects(_weighted(spark, sf_dir))
    return eff.select("outcome_id", *[F.round(c, ROUND).alias(c) for c in ("r1", "r0", "rd", "rr", "nnt")])


def treatment_model(spark, sf_dir):
    """Fitted coefficients per outcome and model (rows-only check)."""
    fits = _fitted(spark, sf_dir)[1]
    rows = []
    for oid, (den, num) in fits.items():
        for model, fit in (("denominator", den), ("numerator", num)):
            rows.append((oid, model, "(intercept)", fit.intercept))
            rows += [(oid, model, term, beta) for term, beta in fit.coefficients.items()]
    return spark.createDataFrame(rows, "outcome_id int, model string, term string, estimate double")


def _fitted(spark, sf_dir):
    prep = _prepared(spark, sf_dir)
    return prep, A.fit_models(prep, sorted(E.OUTCOMES), materialise=cut)


def numerator_model(spark, sf_dir):
    """The fitted coefficients of the numerator model (SQL solves the same normal equations)."""
    fits = _fitted(spark, sf_dir)[1]
    rows = [(oid, num.intercept, num.coefficients.get("cal_time", 0.0), num.coefficients.get("time_sq", 0.0))
            for oid, (_, num) in fits.items()]
    df = spark.createDataFrame(rows, "outcome_id int, intercept double, cal_time double, time_sq double")
    return df.select("outcome_id", *[F.round(c, 4).alias(c) for c in ("intercept", "cal_time", "time_sq")])


def denominator_score(spark, sf_dir):
    """O44 + O45: size of the score of each term, summed over the at-risk rows and divided by their
    number. At the maximum of the likelihood every one is 0, also those of dropped aliased terms."""
    prep, fits = _fitted(spark, sf_dir)
    numeric, factors = A.denominator_terms()
    rows = A.with_fitted(prep, fits).where("at_risk = 1 and complete")
    rows = rows.withColumn("_r", col("pabx_start") - col("p_den"))
    terms = F.array(F.struct(F.lit("(intercept)").alias("term"), F.lit(1.0).alias("x")),
                    *[F.struct(F.lit(c).alias("term"), col(c).cast("double").alias("x")) for c in numeric],
                    *[F.struct(F.concat(F.lit(f"{f}="), col(f)).alias("term"), F.lit(1.0).alias("x")) for f in factors])
    long = rows.select("outcome_id", "_r", F.explode(terms).alias("t"))
    n = rows.groupBy("outcome_id").agg(F.count(F.lit(1)).alias("n"))
    top = long.groupBy("outcome_id", col("t.term").alias("term")).agg(
        F.sum(col("_r") * col("t.x")).alias("s"), F.max(F.abs(col("t.x"))).alias("m"))
    size = F.abs(col("s")) / (col("n") * F.greatest(col("m"), F.lit(1.0)))
    return top.join(F.broadcast(n), "outcome_id").select("outcome_id", "term", F.round(size, 4).alias("score"))


def effects_modelled(spark, sf_dir):
    return A.effects_fitted(_prepared(spark, sf_dir), PARAMS, sorted(E.OUTCOMES), materialise=cut, dealt=True)


def effects_small_model(spark, sf_dir):
    """O44-O52 end to end with a fitted denominator of three terms (SQL takes the same Newton steps)."""
    eff = A.effects_fitted(_prepared(spark, sf_dir), PARAMS, sorted(E.OUTCOMES), materialise=cut, denominator=SMALL_MODEL, dealt=True)
    return eff.select("outcome_id", *[F.round(c, 6).alias(c) for c in ("r1", "r0", "rd", "rr", "nnt")])


# ---------------------------------------------------------------- as documented
def _pre_documented(spark, sf_dir):
    return _baseline(spark, sf_dir, "pre-documented", DOCUMENTED)


def cohort_exit_documented(spark, sf_dir):
    """The age limit of the exit rules in years."""
    return T.exit_cohort(_cat(spark, sf_dir), DOCUMENTED).select("alf_pe", "diag_date", "dod", "cohort_end_dt", "cohort_end_reason")


def competing_events_documented(spark, sf_dir):
    """The outcome comes first on the day of a new episode."""
    cat, pre = _pre_documented(spark, sf_dir)
    ids = sorted(E.OUTCOMES)
    facts = T.patient_facts(pre, cat, DOCUMENTED, exclude=False)
    stacked = T.stacked_panel(facts, T.missing_dates(cat, pre, DOCUMENTED, ids), DOCUMENTED, ids, pre.count())
    df = O.resolve_competing(stacked.withColumn("outcome", O.outcome_flag(DOCUMENTED)), DOCUMENTED)
    return df.select("alf_pe", col("outcome_id").cast("int"), "cal_time", "death", "ltf", "study_ended",
                     "diag_12months", "new_pabx", col("outcome").cast("int"))


def closest_specimen_documented(spark, sf_dir):
    """No evidence is a code of its own."""
    cat, pre = _pre_documented(spark, sf_dir)
    return O.closest_specimen(pre, cat.urine_tests, DOCUMENTED)


def co_occurring_documented(spark, sf_dir):
    """A UTI code in the same episode."""
    return _co_occurring(_pre_documented(spark, sf_dir), DOCUMENTED)


def lab_multi_documented(spark, sf_dir):
    """Two different drugs."""
    cat = _cat(spark, sf_dir)
    return E.multi_resistant_events(cat.cohort, cat.urine_tests, DOCUMENTED).select(
        "alf_pe", "spcm_collected_dt", "report_seq", "request_seq", col("resistant_count").cast("int"))


def uti_counts_gp_documented(spark, sf_dir):
    """A GP episode inside any hospital episode does not count."""
    return _pre_documented(spark, sf_dir)[1].select("alf_pe", "gp_uti_pre")


def clones_censored_documented(spark, sf_dir):
    """The untreated arm leaves at the start, whenever in the grace period it is."""
    df = M.censor_clones(_prepared_documented(spark, sf_dir), DOCUMENTED)
    return df.select("alf", "outcome_id", col("arm").cast("int"), "cal_time", col("censor_pos").cast("int"),
                     col("my_censor").cast("int"), col("outcome").cast("int"), "pabx_start")


def model_features_documented(spark, sf_dir):
    """A missing rate counts as 0, a missing factor is a level; every row is complete."""
    df = _prepared_documented(spark, sf_dir)
    return df.select("alf", "outcome_id", "cal_time", F.round("gp_prescrib_rate", ROUND).alias("gp_prescrib_rate"),
                     *[f"{f}_lvl" for f in W.FACTORS], col("complete").cast("int").alias("complete"))


def bootstrap_ci(spark, sf_dir):
    ci = A.bootstrap_fixed(_weighted(spark, sf_dir), replicates=BOOTSTRAP_REPLICATES, seed=BOOTSTRAP_SEED)
    return ci.select("outcome_id", col("replicates").cast("int"),
                     *[F.round(c, 6).alias(c) for c in ci.columns if c.endswith(("_lo", "_hi"))])


def bootstrap_refit_ci(spark, sf_dir):
    """O53 (b): intervals with the weight models refitted per replicate (rows-only check)."""
    prep = _prepared(spark, sf_dir)
    ci = A.bootstrap_refit(prep, PARAMS, sorted(E.OUTCOMES), replicates=REFIT_REPLICATES, seed=BOOTSTRAP_SEED,
                           materialise=cut)
    return ci.select("outcome_id", col("replicates").cast("int"), "unconverged",
                     *[F.round(c, 6).alias(c) for c in ci.columns if c.endswith(("_lo", "_hi"))])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cohort_exit": cohort_exit,
    "prior_exposure_excluded": prior_exposure_excluded,
    "contact_days": _pre_cols("gp_int_days"),
    "ethnicity_fill": _pre_cols("ethnic"),
    "exposure_bounds": _pre_cols("pabx_str", "days_to_pabx", "first_abx_dt", "pabx_end"),
    "dose_at_start": _pre_cols("dose", "dose_consistency"),
    "next_episode": _pre_cols("next_pabx_str", "cohort_end_reason"),
    "first_exposure_ever": _pre_cols("pabx_str_all", "pabx_all_first_script", "pabx_end_all"),
    "practice_rate": _pre_cols("gp_presc_rt"),
    "baseline_resistance": _pre_cols("amr_baseline"),
    "follow_up_end": _pre_cols("min_end_dt"),
    "interval_panel": interval_panel,
    "exposure_flags": exposure_flags,
    "exit_flags": exit_flags,
    "uti_counts_gp": _pre_cols("gp_uti_pre"),
    "uti_counts_hosp": _pre_cols("pedw_uti_pre"),
    "hospital_events": hospital_events,
    "recent_discharge": recent_discharge,
    "co_occurring": co_occurring,
    "lab_any": _lab(any_resistant),
    "lab_trim": _lab(lambda: resistant_to("trimethoprim")),
    "lab_nitro": _lab(lambda: resistant_to("nitrofurantoin")),
    "lab_multi": lab_multi,
    "first_event": first_event,
    "outcome_flag": outcome_flag,
    "competing_events": competing_events,
    "trimmed_panel": trimmed_panel,
    "inclusion_days": inclusion_days,
    "closest_specimen": closest_specimen,
    "exposure_type": exposure_type,
    "clamped_exposure": clamped_exposure,
    "death_after_outcome": death_after_outcome,
    "next_event": next_event,
    "started_before_index": started_before_index,
    "unique_key_check": unique_key_check,
    "outcome_table": outcome_table,
    "all_outcomes": all_outcomes,
    "clones_censored": clones_censored,
    "weights_given_probs": weights_given_probs,
    "weighted_km": weighted_km,
    "effects": effects,
    "bootstrap_ci": bootstrap_ci,
    "numerator_model": numerator_model,
    "denominator_score": denominator_score,
    "treatment_model": treatment_model,
    "effects_modelled": effects_modelled,
    "effects_small_model": effects_small_model,
    "cohort_exit_documented": cohort_exit_documented,
    "competing_events_documented": competing_events_documented,
    "closest_specimen_documented": closest_specimen_documented,
    "co_occurring_documented": co_occurring_documented,
    "lab_multi_documented": lab_multi_documented,
    "uti_counts_gp_documented": uti_counts_gp_documented,
    "clones_censored_documented": clones_censored_documented,
    "model_features_documented": model_features_documented,
    "bootstrap_refit_ci": bootstrap_refit_ci,
}
