"""DuckDB SQL for the panel, the outcome template and the analysis (oracle side)."""

from __future__ import annotations

import math

from oracle import values as V
from oracle.roles import S0, S1, addm, any_resistant, q, ql
from trialspark.params import FIXTURE_PARAMS as P

IN_WEEK = "{} BETWEEN cal_dt AND cal_dt + 6"


def _exit_flag(reason: str, day: str, name: str) -> str:
    return f"CASE WHEN cohort_end_reason = {q(reason)} AND {IN_WEEK.format(day)} THEN 1 ELSE 0 END AS {name}"


def _covered(start: str, end: str, name: str) -> str:
    return f"CASE WHEN {start} <= cal_dt + 6 AND (cal_dt <= {start} OR cal_dt <= {end}) THEN 1 ELSE 0 END AS {name}"


PANEL = [
    ("weeks", """SELECT alf_pe, unnest(range(CAST(greatest(1, ceil((min_end_dt - diag_date + 1) / 7.0)) AS INTEGER)))::INTEGER AS cal_time
        FROM pre WHERE diag_date IS NOT NULL"""),
    ("pre2", f"""SELECT alf_pe, diag_date AS ruti_diag_dt, diag_date + 7 * cal_time AS cal_dt, cal_time, first_abx_dt, pabx_str, pabx_end,
        gp_end_date AS gp_end_dt, {S1} AS study_end, dod, next_pabx_str, cohort_end_reason, min_end_dt, pabx_str_all,
        pabx_all_first_script, pabx_end_all, {addm("diag_date", P.followup_months)} AS year_on
        FROM weeks JOIN pre USING (alf_pe)"""),
    ("pre2f", f"""SELECT *, {_covered('pabx_str', 'pabx_end', 'pabx')}, {_covered('pabx_str_all', 'pabx_end_all', 'all_pabx')},
        {_exit_flag(V.DIED, 'dod', 'death')}, {_exit_flag(V.LEFT, 'gp_end_dt', 'ltf')},
        {_exit_flag(V.STUDY_END, 'study_end', 'study_ended')}, {_exit_flag(V.NEW, 'next_pabx_str', 'new_pabx')},
        {_exit_flag(V.TWELVE_MONTHS, 'year_on', 'diag_12months')}
        FROM pre2"""),
]

_KEYS = "alf_pe, spcm_collected_dt, report_seq, request_seq"
_drugs_resisted = " + ".join(f"count(*) FILTER ('Resistant' IN ({', '.join(names)}))" for names in V.DRUGS)


def _without_recent(events: str) -> str:
    """Events on days when no event of the patient follows the end of another stay too soon."""
    return f"""FROM {events} ANTI JOIN (
        SELECT DISTINCT alf_pe, epi_str_dt FROM {events} e JOIN spell s USING (alf_pe)
        WHERE s.spell_num_pe <> e.spell_num_pe AND e.epi_str_dt - s.disch_dt BETWEEN 0 AND {P.discharge_gap_days}
        ) USING (alf_pe, epi_str_dt)"""


EVENTS = [
    ("stays", f"""SELECT alf_pe, prov_unit_cd, spell_num_pe, epi_num, epi_str_dt, diag_cd_1234,
        list_contains([{ql(V.RESISTANT_CODES)}], diag_cd_1234) AS resistant,
        regexp_matches(diag_cd_1234, '{"|".join(V.UTI_PARTS)}') AS infected
        FROM diagnosis JOIN episode USING (prov_unit_cd, spell_num_pe, epi_num) JOIN spell USING (prov_unit_cd, spell_num_pe)
        JOIN (SELECT alf_pe, diag_date FROM pre) USING (alf_pe)
        WHERE epi_str_dt > greatest(diag_date, {S0} - 1) AND epi_str_dt <= {S1}
          AND epi_str_dt - admis_dt BETWEEN 0 AND {P.admission_window_days}"""),
    ("resistant_stays", "FROM stays WHERE resistant"),
    ("infected_stays", "FROM stays s SEMI JOIN resistant_stays USING (alf_pe, prov_unit_cd, spell_num_pe) WHERE s.infected"),
    ("resistant_clear", _without_recent("resistant_stays")),
    ("infected_clear", _without_recent("infected_stays")),
    ("later_tests", "SELECT t.* FROM urine_tests t JOIN cohort1 USING (alf_pe) WHERE spcm_collected_dt > diag_date"),
    ("lab_any", f"SELECT {_KEYS} FROM later_tests WHERE {any_resistant}"),
    ("lab_trim", f"SELECT {_KEYS} FROM later_tests WHERE trimethoprim = 'Resistant'"),
    ("lab_nitro", f"SELECT {_KEYS} FROM later_tests WHERE nitrofurantoin = 'Resistant'"),
    ("lab_multi", f"SELECT {_KEYS}, {_drugs_resisted} AS resistant_count FROM later_tests GROUP BY {_KEYS} HAVING resistant_count > 1"),
    ("firsts", """SELECT alf_pe, outcome_id, min(day) AS outcome_dt FROM (
        SELECT alf_pe, 1 AS outcome_id, epi_str_dt AS day FROM resistant_clear
        UNION ALL SELECT alf_pe, 2, epi_str_dt FROM infected_clear
        UNION ALL SELECT alf_pe, 3, spcm_collected_dt FROM lab_any
        UNION ALL SELECT alf_pe, 4, spcm_collected_dt FROM lab_multi
        UNION ALL SELECT alf_pe, 5, spcm_collected_dt FROM lab_trim
        UNION ALL SELECT alf_pe, 6, spcm_collected_dt FROM lab_nitro) GROUP BY alf_pe, outcome_id"""),
]

_culture_rank = "nullif(list_position([" + ql([c for c, _ in V.CULTURES]) + "], uti_outcome), 0)"
_culture_value = str([v for _, v in V.CULTURES])
_early = "<=" if P.documented else "<"
OUTCOME = [
    ("flagged", f"""SELECT w.*, outcome_id, outcome_dt,
        coalesce({IN_WEEK.format('outcome_dt')} AND outcome_dt <= list_min([dod, gp_end_dt, study_end, year_on]), false) AS hit
        FROM pre2f w CROSS JOIN (SELECT unnest(range(1, 7))::INTEGER AS outcome_id) LEFT JOIN firsts USING (alf_pe, outcome_id)"""),
    # an outcome in the week takes the place of the other ways to leave, a new episode only if the outcome is earlier
    ("resolved", f"""SELECT * REPLACE (if(hit, 0, death) AS death, if(hit, 0, ltf) AS ltf, if(hit, 0, study_ended) AS study_ended,
            if(hit, 0, diag_12months) AS diag_12months,
            if(hit AND outcome_dt {_early} next_pabx_str, 0, new_pabx) AS new_pabx),
        CAST(hit AS INTEGER) AS outcome_raw,
        if(hit AND (new_pabx = 0 OR outcome_dt {_early} next_pabx_str), 1, 0) AS outcome
        FROM flagged"""),
    ("trimmed", """FROM resolved WHERE (outcome_dt IS NULL OR cal_dt <= outcome_dt)
        AND (next_pabx_str IS NULL OR cal_dt <= next_pabx_str)"""),
    ("included", """SELECT alf_pe, outcome_id, CAST(list_extract([any_value(gp_end_dt), any_value(dod), any_value(outcome_dt),
            any_value(next_pabx_str), any_value(year_on), any_value(study_end)],
            list_position([sum(ltf) = 1, sum(death) = 1, sum(outcome) = 1, sum(new_pabx) = 1, sum(diag_12months) = 1, true], true))
        - any_value(ruti_diag_dt) AS INTEGER) AS fup_obs
        FROM trimmed GROUP BY alf_pe, outcome_id"""),
    ("closest", f"""SELECT alf_pe, {_culture_value}[min({_culture_rank})] AS most_recent_urine FROM (
        SELECT alf_pe, uti_outcome FROM urine_tests JOIN pre USING (alf_pe)
        WHERE spcm_collected_dt BETWEEN {addm('diag_date', -12 * P.specimen_lookback_years)} AND diag_date
        QUALIFY rank() OVER (PARTITION BY alf_pe ORDER BY spcm_collected_dt DESC) = 1) GROUP BY alf_pe"""),
    ("kinds", f"""SELECT alf_pe, min(alt_abx_type) AS pabx_type FROM (
        SELECT alf_pe, alt_abx_type FROM exposure_starts s JOIN (SELECT alf_pe, diag_date FROM pre) USING (alf_pe)
        WHERE s.pabx_str >= diag_date AND s.pabx_str < {addm('diag_date', P.followup_months)}
        QUALIFY rank() OVER (PARTITION BY alf_pe ORDER BY s.pabx_str) = 1) GROUP BY alf_pe"""),
    ("observed", """SELECT alf_pe, diag_date, first_abx_dt, pabx_all_first_script,
        if(pabx_str <= min_end_dt, pabx_str, NULL) AS pabx_str_c,
        if(pabx_str <= min_end_dt, if(pabx_end > min_end_dt, min_end_dt, pabx_end), NULL) AS pabx_end_c,
        if(pabx_str_all <= min_end_dt, pabx_str_all, NULL) AS pabx_str_all_c,
        if(pabx_str_all <= min_end_dt, if(pabx_end_all > min_end_dt, min_end_dt, pabx_end_all), NULL) AS pabx_end_all_c,
        CAST(pabx_end_c - first_abx_dt AS INTEGER) AS pabx_duration,
        CAST(pabx_end_all_c - pabx_all_first_script AS INTEGER) AS pabx_duration_all
        FROM pre"""),
    ("next_uti", """SELECT alf_pe, min(event_str_dt) AS next_uti_dt FROM all_uti JOIN pre USING (alf_pe)
        WHERE event_str_dt > diag_date GROUP BY alf_pe"""),
    ("too_early", """SELECT DISTINCT alf_pe FROM observed JOIN exposure_starts s USING (alf_pe)
        WHERE s.pabx_str = pabx_str_c AND alt_str_dt < diag_date AND diag_date <= pabx_str_c"""),
    ("weeks_out", """SELECT t.*, p.* EXCLUDE (alf_pe, diag_date, first_abx_dt, pabx_str, pabx_end, dod, next_pabx_str, cohort_end_reason,
            min_end_dt, pabx_str_all, pabx_all_first_script, pabx_end_all, pabx), fup_obs, most_recent_urine, pabx_type, pabx_duration,
        pabx_duration_all, next_uti_dt,
        coalesce(pabx_str_c <= list_min([t.min_end_dt, t.outcome_dt]), false) AS counts,
        coalesce(pabx_str_all_c <= list_min([t.min_end_dt, t.outcome_dt]), false) AS counts_all
        FROM trimmed t ANTI JOIN too_early USING (alf_pe) JOIN pre p USING (alf_pe) JOIN included USING (alf_pe, outcome_id)
        JOIN (SELECT alf_pe, pabx_str_c, pabx_str_all_c, pabx_duration, pabx_duration_all FROM observed) USING (alf_pe)
        LEFT JOIN closest USING (alf_pe) LEFT JOIN kinds USING (alf_pe) LEFT JOIN next_uti USING (alf_pe)"""),
    # the published columns and their names
    ("final", f"""SELECT alf_pe AS alf, outcome_id, ruti_diag_dt AS ruti_diagdate, cal_time, fup_obs, wob AS birth_week,
        agediag AS ruti_age, ethnic, wimd_2019_quintile AS wimd, bmi_val AS bmi, smok AS smoking, alcohol_flg AS alcohol,
        efi AS frailty, diabetes AS diab, cancer, renal_disease AS ckd, hypertension AS htn, w.cvd AS ihd, cerebrov AS cvd,
        heartfail AS ccf, ms, mnd, dementia, parkinsons AS pd, smh AS severe_ment, asthma, copd, immun_supp, renal_stone,
        abn_renal AS urin_tract_abnorm, amr_baseline, most_recent_urine, gp_uti_pre AS utis_gp_baseline,
        pedw_uti_pre AS utis_hosp_baseline, gp_presc_rt AS gp_prescrib_rate,
        if(counts, pabx, 0) AS pabx_start, if(counts, pabx_type, NULL) AS pabx_type, if(counts, dose, NULL) AS dose,
        if(counts, dose_consistency, NULL) AS dose_consistency, if(counts, days_to_pabx, NULL) AS time_to_pabx,
        if(counts, w.pabx_duration, NULL) AS pabx_duration, if(counts_all, w.all_pabx, 0) AS all_pabx,
        if(counts_all, pabx_duration_all, NULL) AS all_pabx_duration, gp_int_days, outcome, outcome_dt, death,
        dod AS death_dt, ltf AS fu_loss, gp_end_dt AS fu_loss_dt, study_ended AS study_end, diag_12months,
        year_on AS diag_12months_dt, new_pabx AS new_pabx_str, next_pabx_str AS new_pabx_str_dt,
        CASE WHEN dod BETWEEN outcome_dt AND coalesce(gp_end_dt, w.study_end) THEN 1 ELSE 0 END AS death_after_outcome,
        CASE WHEN {IN_WEEK.format('next_uti_dt')} THEN 1 ELSE 0 END AS next_uti
        FROM weeks_out w"""),
]

_g = P.grace_weeks

ANALYSIS = [
    # place (from 1) of the first start after the index week, and the rows of the patient
    ("placed", """SELECT alf, outcome_id, cal_time, pabx_start, outcome, ruti_age, diab, count(*) OVER patient AS n,
        min(cal_time + 1) FILTER (pabx_start = 1 AND cal_time >= 1) OVER patient AS place
        FROM final WINDOW patient AS (PARTITION BY alf, outcome_id)"""),
    # untreated arm: leaves at the start up to place 4, one place later from 5 on if there is such a row;
    # treated arm: leaves when the grace period has passed without a start
    ("risk", f"""SELECT *, CASE WHEN place <= 4 THEN place WHEN place <= {_g} AND place < n THEN place + 1 END AS c0,
        CASE WHEN n > {_g} AND coalesce(place, n + 1) > {_g + 1} THEN {_g + 1} END AS c1,
        CASE WHEN cal_time < least({_g} + 1, coalesce(place, {_g} + 1)) THEN 1 ELSE 0 END AS at_risk
        FROM placed"""),
    ("probs", """SELECT *, 1.0 / (1.0 + exp(-(-2.0 + 0.01 * ruti_age - 0.1 * cal_time + 0.3 * diab))) AS p_den,
        1.0 / (1.0 + exp(-(-2.0 - 0.1 * cal_time))) AS p_num FROM risk"""),
    ("probs_t", """SELECT *, CASE WHEN at_risk = 1 THEN CASE WHEN pabx_start = 1 THEN p_den ELSE 1.0 - p_den END ELSE 1.0 END
            AS p_den_t,
        CASE WHEN at_risk = 1 THEN CASE WHEN pabx_start = 1 THEN p_num ELSE 1.0 - p_num END ELSE 1.0 END AS p_num_t
        FROM probs"""),
    ("sw", """SELECT *, product(p_num_t) OVER w / product(p_den_t) OVER w AS sw_a FROM probs_t
        WINDOW w AS (PARTITION BY alf, outcome_id ORDER BY cal_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("clones", """SELECT s.*, arm, if(arm = 0, c0, c1) AS censor_pos FROM sw s CROSS JOIN (SELECT unnest([0, 1]) AS arm)"""),
    ("kept", """SELECT * EXCLUDE (outcome), CASE WHEN cal_time + 1 = censor_pos THEN 1 ELSE 0 END AS my_censor,
        CASE WHEN cal_time + 1 = censor_pos THEN NULL ELSE outcome END AS outcome
        FROM clones WHERE censor_pos IS NULL OR cal_time + 1 <= censor_pos"""),
    ("thr", f"""SELECT outcome_id, quantile_cont(CAST(sw_a AS DOUBLE), {P.weight_q}) AS thr FROM kept GROUP BY outcome_id"""),
    ("trunc", """SELECT k.*, CASE WHEN k.sw_a > t.thr THEN t.thr ELSE k.sw_a END AS sw_trunc FROM kept k
        JOIN thr t USING (outcome_id)"""),
    ("km", """SELECT outcome_id, arm, cal_time, n_risk, n_event,
        product(1.0 - coalesce(n_event / nullif(n_risk, 0), 0.0)) OVER (PARTITION BY outcome_id, arm ORDER BY cal_time
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS surv
        FROM (SELECT outcome_id, arm, cal_time, sum(sw_trunc) AS n_risk, sum(sw_trunc * outcome) AS n_event
              FROM trunc WHERE outcome IS NOT NULL GROUP BY outcome_id, arm, cal_time)"""),
    ("eff", """SELECT outcome_id, 1 - max(CASE WHEN arm = 1 THEN s END) AS r1, 1 - max(CASE WHEN arm = 0 THEN s END) AS r0
        FROM (SELECT outcome_id, arm, min(surv) AS s FROM km GROUP BY outcome_id, arm) GROUP BY outcome_id"""),
]


# Newton steps for a logistic model in time and its square, on counts by week; 3 x 3 equations solved by cofactors.
NUMERATOR = [
    ("tally", """SELECT outcome_id, CAST(cal_time AS DOUBLE) AS t, sum(pabx_start) AS y, count(*) AS n
        FROM risk WHERE at_risk = 1 GROUP BY ALL"""),
    ("newton", """SELECT DISTINCT outcome_id, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM tally
        UNION ALL
        SELECT outcome_id, step + 1,
            a + ((h2 * h4 - h3 * h3) * g0 + (h2 * h3 - h1 * h4) * g1 + (h1 * h3 - h2 * h2) * g2) / d,
            b + ((h2 * h3 - h1 * h4) * g0 + (h0 * h4 - h2 * h2) * g1 + (h1 * h2 - h0 * h3) * g2) / d,
            c + ((h1 * h3 - h2 * h2) * g0 + (h1 * h2 - h0 * h3) * g1 + (h0 * h2 - h1 * h1) * g2) / d
        FROM (SELECT *, h0 * (h2 * h4 - h3 * h3) - h1 * (h1 * h4 - h2 * h3) + h2 * (h1 * h3 - h2 * h2) AS d
              FROM (SELECT outcome_id, step, a, b, c, sum(y - n * p) AS g0, sum(t * (y - n * p)) AS g1, sum(t * t * (y - n * p)) AS g2,
                        sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * t) AS h1, sum(n * p * (1 - p) * t ** 2) AS h2,
                        sum(n * p * (1 - p) * t ** 3) AS h3, sum(n * p * (1 - p) * t ** 4) AS h4
                    FROM (SELECT w.*, t, y, n, 1 / (1 + exp(-(a + b * t + c * t * t))) AS p FROM newton w JOIN tally USING (outcome_id))
                    GROUP BY outcome_id, step, a, b, c))
        WHERE step < 12"""),
]

# The same for a denominator of time and age on complete rows, then weights, curves and effects from the two fits.
_KNOWN = "frailty + wimd + most_recent_urine + gp_prescrib_rate IS NOT NULL"
SMALL = [
    ("covered", f"""SELECT r.*, CAST(r.ruti_age AS DOUBLE) AS u, {_KNOWN} AS known FROM risk r JOIN (SELECT alf, outcome_id, cal_time, frailty, wimd,
        most_recent_urine, gp_prescrib_rate FROM final) USING (alf, outcome_id, cal_time)"""),
    ("tally2", """SELECT outcome_id, CAST(cal_time AS DOUBLE) AS t, u, sum(pabx_start) AS y, count(*) AS n
        FROM covered WHERE at_risk = 1 AND known GROUP BY ALL"""),
    ("newton2", """SELECT DISTINCT outcome_id, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM tally2
        UNION ALL
        SELECT outcome_id, step + 1,
            a + ((h11 * h22 - h12 * h12) * g0 + (h02 * h12 - h01 * h22) * g1 + (h01 * h12 - h02 * h11) * g2) / d,
            b + ((h02 * h12 - h01 * h22) * g0 + (h00 * h22 - h02 * h02) * g1 + (h01 * h02 - h00 * h12) * g2) / d,
            c + ((h01 * h12 - h02 * h11) * g0 + (h01 * h02 - h00 * h12) * g1 + (h00 * h11 - h01 * h01) * g2) / d
        FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d
              FROM (SELECT outcome_id, step, a, b, c, sum(y - n * p) AS g0, sum(t * (y - n * p)) AS g1, sum(u * (y - n * p)) AS g2,
                        sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * t) AS h01, sum(n * p * (1 - p) * u) AS h02,
                        sum(n * p * (1 - p) * t * t) AS h11, sum(n * p * (1 - p) * t * u) AS h12, sum(n * p * (1 - p) * u * u) AS h22
                    FROM (SELECT w.*, t, u, y, n, 1 / (1 + exp(-(a + b * t + c * u))) AS p FROM newton2 w JOIN tally2 USING (outcome_id))
                    GROUP BY outcome_id, step, a, b, c))
        WHERE step < 14"""),
    ("fitted", """SELECT f.*, if(known, 1 / (1 + exp(-(k.a + k.b * f.cal_time + k.c * f.u))), NULL) AS p_den,
        1 / (1 + exp(-(m.a + m.b * f.cal_time + m.c * f.cal_time * f.cal_time))) AS p_num
        FROM covered f JOIN newton2 k ON k.outcome_id = f.outcome_id AND k.step = 14 JOIN newton m ON m.outcome_id = f.outcome_id AND m.step = 12"""),
    ("fitted_t", """SELECT *, if(at_risk = 1, if(pabx_start = 1, p_den, 1 - p_den), 1.0) AS p_den_t,
        if(at_risk = 1, if(pabx_start = 1, p_num, 1 - p_num), 1.0) AS p_num_t FROM fitted"""),
    ("fitted_w", """SELECT *, if(count(*) FILTER (p_den_t IS NULL) OVER w > 0, NULL, product(p_num_t) OVER w / product(p_den_t) OVER w) AS sw_a FROM fitted_t
        WINDOW w AS (PARTITION BY alf, outcome_id ORDER BY cal_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("fitted_clones", """SELECT s.* EXCLUDE (outcome), arm, if(arm = 0, c0, c1) AS leaves, s.outcome AS seen
        FROM fitted_w s CROSS JOIN (SELECT unnest([0, 1]) AS arm)"""),
    ("fitted_kept", """SELECT *, if(cal_time + 1 = leaves, NULL, seen) AS outcome FROM fitted_clones WHERE leaves IS NULL OR cal_time + 1 <= leaves"""),
    ("fitted_cut", f"""SELECT *, least(sw_a, quantile_cont(sw_a, {P.weight_q}) OVER (PARTITION BY outcome_id)) AS w FROM fitted_kept WHERE sw_a IS NOT NULL"""),
    ("fitted_km", """SELECT outcome_id, arm, cal_time, product(1.0 - coalesce(event / nullif(risk, 0), 0.0)) OVER (PARTITION BY outcome_id, arm
            ORDER BY cal_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS surv
        FROM (SELECT outcome_id, arm, cal_time, sum(w) AS risk, sum(w * outcome) AS event FROM fitted_cut WHERE outcome IS NOT NULL
              GROUP BY outcome_id, arm, cal_time)"""),
    ("fitted_effects", """SELECT outcome_id, 1 - min(surv) FILTER (arm = 1) AS r1, 1 - min(surv) FILTER (arm = 0) AS r0 FROM fitted_km GROUP BY outcome_id"""),
]

_levels = " UNION ALL ".join(
    f"SELECT outcome_id, '{f}_lvl=' || CAST({f} AS VARCHAR) AS term FROM at_risk_rows"
    for f in ("frailty", "wimd", "most_recent_urine"))


def denominator_terms(numeric: list[str]) -> list[tuple[str, str]]:
    """Every term of the denominator model: its score must be 0."""
    return [
        ("at_risk_rows", "SELECT f.* FROM final f JOIN risk r USING (alf, outcome_id, cal_time) "
                         "WHERE r.at_risk = 1 AND frailty + wimd + most_recent_urine + gp_prescrib_rate IS NOT NULL"),
        ("terms", f"SELECT DISTINCT outcome_id, term FROM ({_levels} UNION ALL "
                  f"SELECT outcome_id, unnest([{ql(['(intercept)', *numeric])}]) FROM at_risk_rows)"),
    ]


def bootstrap(replicates: int, seed: int) -> list[tuple[str, str]]:
    """Poisson(1) patient multiplicities from md5(alf:rep:seed), KM per replicate, percentile interval."""
    shares = [math.exp(-1.0) / math.factorial(k) for k in range(14)]
    mult = " + ".join(f"CASE WHEN u >= {math.fsum(shares[: k + 1])!r} THEN 1 ELSE 0 END" for k in range(13))
    q = lambda m, p: f"quantile_cont({m}, {p})"
    cis = ", ".join(f"{q(e, 0.025)} AS {m}_lo, {q(e, 0.975)} AS {m}_hi" for m, e in
                    (("rd", "r1 - r0"), ("rr", "r1 / nullif(r0, 0)"), ("r1", "r1"), ("r0", "r0")))
    return [
        ("bs_counts", f"""SELECT alf, rep, {mult} AS mult FROM (
            SELECT alf, rep, CAST(('0x' || substr(md5(alf || ':' || CAST(rep AS VARCHAR) || ':{seed}'), 1, 8))
                AS BIGINT) / 4294967296.0 AS u
            FROM (SELECT DISTINCT alf FROM trunc) CROSS JOIN (SELECT range AS rep FROM range(1, {replicates + 1})))"""),
        ("bs_steps", """SELECT t.outcome_id, t.arm, c.rep, t.cal_time, sum(t.sw_trunc * c.mult) AS n_risk,
            sum(t.sw_trunc * c.mult * t.outcome) AS n_event
            FROM trunc t JOIN bs_counts c ON t.alf = c.alf WHERE t.outcome IS NOT NULL AND c.mult > 0
            GROUP BY t.outcome_id, t.arm, c.rep, t.cal_time"""),
        ("bs_km", """SELECT outcome_id, arm, rep, min(surv) AS s FROM (
            SELECT *, product(1.0 - coalesce(n_event / nullif(n_risk, 0), 0.0)) OVER (
                PARTITION BY outcome_id, arm, rep ORDER BY cal_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                AS surv FROM bs_steps) GROUP BY outcome_id, arm, rep"""),
        ("bs_eff", """SELECT outcome_id, rep, 1 - max(CASE WHEN arm = 1 THEN s END) AS r1,
            1 - max(CASE WHEN arm = 0 THEN s END) AS r0 FROM bs_km GROUP BY outcome_id, rep"""),
        ("bs_ci", f"SELECT outcome_id, CAST(count(*) AS INTEGER) AS replicates, {cis} FROM bs_eff GROUP BY outcome_id"),
    ]
