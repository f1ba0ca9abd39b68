"""Oracle SQL (DuckDB) for each registered query, same column names and types as the Spark side."""

from __future__ import annotations

from oracle.documented import as_documented
from oracle.roles import with_ctes
from oracle.stages import ANALYSIS, EVENTS, NUMERATOR, OUTCOME, PANEL, SMALL, bootstrap, denominator_terms
from trialspark.plans.registry import BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED

R = 9
# fixed values: numeric terms of the denominator model
NUMERIC_TERMS = [
    "ruti_age", "gp_prescrib_rate", "immun_supp", "diab", "renal_stone", "urin_tract_abnorm",
    "utis_hosp_baseline", "utis_gp_baseline", "amr_baseline", "ruti_age_sq", "gp_prescrib_rate_sq",
    "utis_hosp_baseline_sq", "utis_gp_baseline_sq", "cal_time", "time_sq",
]
_EV = "alf_pe, prov_unit_cd, spell_num_pe, epi_num, epi_str_dt, diag_cd_1234"


def _sql(final: str, *groups) -> str:
    return with_ctes(final, *groups)


def _r(c: str, alias: str | None = None, digits: int = R) -> str:
    return f"round(CAST({c} AS DOUBLE), {digits}) AS {alias or c}"


ORACLE: dict[str, str] = {
    "cohort_exit": _sql("SELECT alf_pe, diag_date, dod, cohort_end_dt, cohort_end_reason FROM leaving"),
    "prior_exposure_excluded": _sql(
        "SELECT alf_pe FROM leaving WHERE alf_pe IN (FROM exposed_before)"),
    "contact_days": _sql("SELECT alf_pe, gp_int_days FROM pre"),
    "ethnicity_fill": _sql("SELECT alf_pe, ethnic FROM pre"),
    "exposure_bounds": _sql("SELECT alf_pe, pabx_str, days_to_pabx, first_abx_dt, pabx_end FROM pre"),
    "dose_at_start": _sql("SELECT alf_pe, dose, dose_consistency FROM pre"),
    "next_episode": _sql("SELECT alf_pe, next_pabx_str, cohort_end_reason FROM pre"),
    "first_exposure_ever": _sql("SELECT alf_pe, pabx_str_all, pabx_all_first_script, pabx_end_all FROM pre"),
    "practice_rate": _sql("SELECT alf_pe, gp_presc_rt FROM pre"),
    "baseline_resistance": _sql("SELECT alf_pe, amr_baseline FROM pre"),
    "follow_up_end": _sql("SELECT alf_pe, min_end_dt FROM pre"),
    "interval_panel": _sql("SELECT alf_pe, cal_time, cal_dt FROM pre2", PANEL),
    "exposure_flags": _sql("SELECT alf_pe, cal_time, pabx, all_pabx FROM pre2f", PANEL),
    "exit_flags": _sql("SELECT alf_pe, cal_time, death, ltf, study_ended, new_pabx, diag_12months FROM pre2f", PANEL),
    "uti_counts_gp": _sql("SELECT alf_pe, gp_uti_pre FROM pre"),
    "uti_counts_hosp": _sql("SELECT alf_pe, pedw_uti_pre FROM pre"),
    "hospital_events": _sql(f"SELECT {_EV} FROM resistant_stays", PANEL, EVENTS),
    "recent_discharge": _sql(f"SELECT {_EV} FROM resistant_clear", PANEL, EVENTS),
    "co_occurring": _sql(f"SELECT DISTINCT {_EV} FROM infected_clear", PANEL, EVENTS),
    "lab_any": _sql("SELECT alf_pe, spcm_collected_dt, report_seq, request_seq FROM lab_any", PANEL, EVENTS),
    "lab_trim": _sql("SELECT alf_pe, spcm_collected_dt, report_seq, request_seq FROM lab_trim", PANEL, EVENTS),
    "lab_nitro": _sql("SELECT alf_pe, spcm_collected_dt, report_seq, request_seq FROM lab_nitro", PANEL, EVENTS),
    "lab_multi": _sql("""SELECT DISTINCT alf_pe, spcm_collected_dt, report_seq, request_seq,
        CAST(resistant_count AS INTEGER) AS resistant_count FROM lab_multi""", PANEL, EVENTS),
    "first_event": _sql("""SELECT alf_pe, CAST(outcome_id AS INTEGER) AS outcome_id, outcome_dt FROM firsts
        WHERE alf_pe IN (SELECT alf_pe FROM pre)""", PANEL, EVENTS),
    "outcome_flag": _sql("""SELECT alf_pe, CAST(outcome_id AS INTEGER) AS outcome_id, cal_time,
        CAST(outcome_raw AS INTEGER) AS outcome FROM resolved""", PANEL, EVENTS, OUTCOME),
    "competing_events": _sql("""SELECT alf_pe, CAST(outcome_id AS INTEGER) AS outcome_id, cal_time, death, ltf,
        study_ended, diag_12months, new_pabx, CAST(outcome AS INTEGER) AS outcome FROM resolved""", PANEL, EVENTS, OUTCOME),
    "trimmed_panel": _sql("SELECT alf_pe, CAST(outcome_id AS INTEGER) AS outcome_id, cal_time, cal_dt FROM trimmed",
                          PANEL, EVENTS, OUTCOME),
    "inclusion_days": _sql("SELECT alf_pe, CAST(outcome_id AS INTEGER) AS outcome_id, fup_obs FROM included",
                           PANEL, EVENTS, OUTCOME),
    "closest_specimen": _sql("SELECT alf_pe, CAST(most_recent_urine AS INTEGER) AS most_recent_urine FROM closest",
                             PANEL, EVENTS, OUTCOME),
    "exposure_type": _sql("SELECT alf_pe, pabx_type FROM kinds", PANEL, EVENTS, OUTCOME),
    "clamped_exposure": _sql("""SELECT alf_pe, pabx_str_c, pabx_end_c, pabx_duration, pabx_str_all_c, pabx_end_all_c,
        pabx_duration_all FROM observed""", PANEL, EVENTS, OUTCOME),
    "death_after_outcome": _sql("""SELECT DISTINCT alf_pe, CAST(outcome_id AS INTEGER) AS outcome_id,
        CASE WHEN dod BETWEEN outcome_dt AND coalesce(gp_end_dt, study_end) THEN 1 ELSE 0 END AS death_after_outcome
        FROM trimmed""", PANEL, EVENTS, OUTCOME),
    "next_event": _sql("SELECT alf_pe, next_uti_dt FROM next_uti", PANEL, EVENTS, OUTCOME),
    "started_before_index": _sql("SELECT alf_pe FROM too_early", PANEL, EVENTS, OUTCOME),
    "unique_key_check": _sql("""SELECT alf_pe, spcm_collected_dt, report_seq, request_seq, CAST(count(*) AS INTEGER) AS n
        FROM urine_tests GROUP BY alf_pe, spcm_collected_dt, report_seq, request_seq HAVING count(*) > 1"""),
    "outcome_table": _sql("SELECT * FROM final WHERE outcome_id = 1", PANEL, EVENTS, OUTCOME),
    "all_outcomes": _sql("SELECT * FROM final", PANEL, EVENTS, OUTCOME),
    "clones_censored": _sql("""SELECT alf, outcome_id, CAST(arm AS INTEGER) AS arm, cal_time,
        CAST(censor_pos AS INTEGER) AS censor_pos, CAST(my_censor AS INTEGER) AS my_censor,
        CAST(outcome AS INTEGER) AS outcome, pabx_start FROM kept""", PANEL, EVENTS, OUTCOME, ANALYSIS),
    "weights_given_probs": _sql(f"""SELECT alf, outcome_id, CAST(arm AS INTEGER) AS arm, cal_time, {_r('sw_a')},
        {_r('sw_trunc')} FROM trunc""", PANEL, EVENTS, OUTCOME, ANALYSIS),
    "weighted_km": _sql(f"""SELECT outcome_id, CAST(arm AS INTEGER) AS arm, cal_time, {_r('n_risk')}, {_r('n_event')},
        {_r('surv')} FROM km""", PANEL, EVENTS, OUTCOME, ANALYSIS),
    "effects": _sql(f"""SELECT outcome_id, {_r('r1')}, {_r('r0')}, {_r('r1 - r0', 'rd')},
        {_r('r1 / nullif(r0, 0)', 'rr')}, {_r('1.0 / nullif(r1 - r0, 0)', 'nnt')} FROM eff""",
                    PANEL, EVENTS, OUTCOME, ANALYSIS),
    "bootstrap_ci": _sql("SELECT outcome_id, replicates, " + ", ".join(
        _r(f"{m}_{e}", digits=6) for m in ("rd", "rr", "r1", "r0") for e in ("lo", "hi")) + " FROM bs_ci",
        PANEL, EVENTS, OUTCOME, ANALYSIS, bootstrap(BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED)),
    "numerator_model": _sql(f"""SELECT outcome_id, {_r('a', 'intercept', 4)}, {_r('b', 'cal_time', 4)}, {_r('c', 'time_sq', 4)}
        FROM newton WHERE step = 12""", PANEL, EVENTS, OUTCOME, ANALYSIS, NUMERATOR),
    "denominator_score": _sql("SELECT outcome_id, term, CAST(0 AS DOUBLE) AS score FROM terms", PANEL, EVENTS, OUTCOME, ANALYSIS,
                              denominator_terms(NUMERIC_TERMS)),
    "effects_small_model": _sql(f"""SELECT outcome_id, {_r('r1', digits=6)}, {_r('r0', digits=6)}, {_r('r1 - r0', 'rd', 6)},
        {_r('r1 / nullif(r0, 0)', 'rr', 6)}, {_r('1.0 / nullif(r1 - r0, 0)', 'nnt', 6)} FROM fitted_effects""",
                                PANEL, EVENTS, OUTCOME, ANALYSIS, NUMERATOR, SMALL),
}
for _name, _difference in (("cohort_exit", "D1"), ("competing_events", "D4"), ("closest_specimen", "D5"), ("co_occurring", "D6"),
                           ("lab_multi", "D8"), ("uti_counts_gp", "D9"), ("clones_censored", "D16")):
    ORACLE[f"{_name}_documented"] = as_documented(ORACLE[_name], _difference)
ORACLE["model_features_documented"] = as_documented(_sql(f"""SELECT alf, outcome_id, cal_time,
    round(coalesce(CAST(gp_prescrib_rate AS DOUBLE), 0.0), {R}) AS gp_prescrib_rate,
    {", ".join(f"coalesce(CAST({f} AS VARCHAR), 'NA') AS {f}_lvl" for f in ("frailty", "wimd", "most_recent_urine"))}, 1 AS complete
    FROM final""", PANEL, EVENTS, OUTCOME))
