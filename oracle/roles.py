"""DuckDB SQL for the fixture roles (FIXTURES.md C) and the baseline stage.

Written from SURVEY's wording of each operator, with names, fixed values and a
structure of its own, not from the Spark operators.
Each entry is one CTE; ``with_ctes`` chains all of them before a final SELECT.
"""

from __future__ import annotations

from oracle import values as V
from trialspark.functions import codes
from trialspark.params import FIXTURE_PARAMS as P
from trialspark.sources import fixtures as FX

S0 = f"DATE '{P.study_start.isoformat()}'"
S1 = f"DATE '{P.study_end.isoformat()}'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ql(items) -> str:
    return ", ".join(q(x) for x in items)


def addm(d: str, n: int) -> str:
    return f"CAST({d} + INTERVAL '{n} months' AS DATE)"


def wk(d: str, cal: str = "cal_dt") -> str:
    return f"({d} BETWEEN {cal} AND {cal} + 6)"


_flags = ",\n        ".join(f"CASE WHEN o.c % {p} = 0 THEN 1 ELSE 0 END AS {n}" for n, p in FX.CONDITION_FLAGS)
_supp = ",\n        ".join(f"CASE WHEN l.l_suppkey % {p} = 0 THEN 'Resistant' ELSE 'Sensitive' END AS {n}"
                           for n, p in FX.SUPPLIER_RESISTANCE)
_types = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(FX.ABX_TYPES))
_diag = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(FX.DIAG_CODE_BY_PART))
_uti = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(codes.UTI_OUTCOME_RANK))

ROLES = [
    ("o", """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, o_orderpriority AS priority,
        CAST(o_orderdate AS DATE) AS dt FROM orders"""),
    ("expo", f"SELECT * FROM o WHERE priority IN ({ql(FX.EXPOSURE_PRIORITIES)})"),
    ("exposure_starts", f"""SELECT CAST(c AS VARCHAR) AS alf_pe, dt AS pabx_str, dt - CAST(k % 5 AS INTEGER) AS alt_str_dt,
        CASE CAST((c + date_diff('day', DATE '1970-01-01', dt)) % 3 AS INTEGER) {_types} END AS alt_abx_type FROM expo"""),
    ("exposure_ends", """SELECT CAST(c AS VARCHAR) AS alf_pe, dt AS pabx_str,
        dt + CAST(k % 120 + 30 AS INTEGER) AS alt_end_dt_comb FROM expo"""),
    ("first_idx", f"SELECT c, min(dt) AS diag_date FROM o WHERE dt BETWEEN {S0} AND {S1} GROUP BY c"),
    ("cohort1", f"""SELECT CAST(o.c AS VARCHAR) AS alf_pe, o.diag_date,
        DATE '{FX.WOB_BASE.isoformat()}' + CAST(o.c * 7919 % 22000 AS INTEGER) AS wob,
        CAST(floor((o.diag_date - (DATE '{FX.WOB_BASE.isoformat()}' + CAST(o.c * 7919 % 22000 AS INTEGER))) / 365.25)
             AS INTEGER) AS agediag,
        CASE WHEN o.c % 11 <> 0 THEN o.diag_date + CAST(o.c * 17 % 2000 AS INTEGER) END AS gp_end_date,
        CASE WHEN o.c % 29 <> 0 THEN CAST(o.c % 5 + 1 AS INTEGER) END AS wimd_2019_quintile,
        CASE WHEN o.c % 4 <> 0 THEN CAST(o.c % 6 + 1 AS INTEGER) END AS ethnic,
        CAST(o.c % 20 + 18 AS INTEGER) AS bmi_val, CAST(o.c % 3 AS INTEGER) AS smok,
        CAST(o.c % 2 AS INTEGER) AS alcohol_flg, CAST(o.c % 4 + 1 AS INTEGER) AS efi,
        {_flags},
        CASE WHEN o.c % 13 = 0 THEN 1 ELSE 0 END AS pabx,
        (SELECT min(e.dt) FROM expo e WHERE e.c = o.c AND e.dt >= o.diag_date
            AND e.dt < {addm('o.diag_date', P.followup_months)}) AS pabx_after_ruti
        FROM first_idx o"""),
    ("deaths", """SELECT CAST(c AS VARCHAR) AS alf_pe, diag_date + CAST(c * 31 % 700 AS INTEGER) AS death_dt
        FROM first_idx WHERE c % 5 = 0"""),
    ("prescriptions", """SELECT CAST(c AS VARCHAR) AS alf_pe, dt AS event_dt, CAST(k % 3 + 1 AS INTEGER) AS event_in_grp,
        CAST(k % 4 AS VARCHAR) AS antibx_category,
        CASE WHEN k % 2 = 0 THEN 'Prophylactic' ELSE 'Treatment' END AS dose,
        CASE WHEN k % 7 = 0 THEN 'Inconsistent' ELSE 'Consistent' END AS dose_consistency FROM expo
        UNION ALL
        SELECT CAST(c AS VARCHAR), dt, CAST(k % 3 + 1 AS INTEGER), CAST((k + 1) % 4 AS VARCHAR),
        CASE WHEN k % 2 = 0 THEN 'Prophylactic' ELSE 'Treatment' END,
        CASE WHEN k % 7 = 0 THEN 'Inconsistent' ELSE 'Consistent' END FROM expo WHERE k % 5 = 0"""),
    ("gp_events", """SELECT CAST(c AS VARCHAR) AS alf_pe, dt AS event_dt,
        CASE WHEN k % 3 = 0 THEN lower(substr(priority, 3)) ELSE priority END AS event_cd FROM o"""),
    ("gp_uti", f"""SELECT CAST(c AS VARCHAR) AS alf_pe, dt AS event_str_dt, dt AS event_end_dt,
        {q(codes.GP_SOURCE)} AS data_source FROM o WHERE status = 'O'"""),
    ("hosp_uti", f"""SELECT CAST(c AS VARCHAR) AS alf_pe, dt AS event_str_dt, dt + CAST(k % 10 AS INTEGER) AS event_end_dt,
        {q(codes.HOSPITAL_SOURCE)} AS data_source FROM o WHERE status = 'P'"""),
    ("all_uti", "SELECT alf_pe, event_str_dt FROM gp_uti UNION ALL SELECT alf_pe, event_str_dt FROM hosp_uti"),
    ("spell", """SELECT CAST(c AS VARCHAR) AS alf_pe, CAST(k % 7 AS VARCHAR) AS prov_unit_cd, k AS spell_num_pe,
        dt AS admis_dt, dt + CAST(k % 12 AS INTEGER) AS disch_dt FROM o"""),
    ("episode", """SELECT CAST(x.k % 7 AS VARCHAR) AS prov_unit_cd, x.k AS spell_num_pe, x.epi_num,
        o.dt + (x.epi_num - 1) AS epi_str_dt, o.dt + greatest(x.epi_num - 1, CAST(x.k % 12 AS INTEGER)) AS epi_end_dt
        FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS epi_num FROM lineitem) x JOIN o ON o.k = x.k"""),
    ("diagnosis", f"""SELECT CAST(k % 7 AS VARCHAR) AS prov_unit_cd, k AS spell_num_pe, epi_num,
        CASE pm {_diag} ELSE 'Z000' END AS diag_cd_1234
        FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS epi_num, CAST(l_partkey % 10 AS INTEGER) AS pm
              FROM lineitem) x"""),
    ("urine_tests", f"""SELECT CAST(o.c AS VARCHAR) AS alf_pe, CAST(l.l_shipdate AS DATE) AS spcm_collected_dt,
        l.l_orderkey AS report_seq, l.l_linenumber AS request_seq,
        CASE WHEN l.l_returnflag = 'R' THEN 'Resistant' ELSE 'Sensitive' END AS trimethoprim,
        CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 'Resistant' ELSE 'Sensitive' END AS nitrofurantoin,
        CASE WHEN l.l_discount >= 0.08 THEN 'Resistant' ELSE 'Sensitive' END AS amoxicillin,
        CASE WHEN l.l_tax >= 0.07 THEN 'Resistant' ELSE 'Sensitive' END AS coamoxiclav,
        {_supp},
        CASE CAST(l.l_partkey % 6 AS INTEGER) {_uti} END AS uti_outcome
        FROM lineitem l JOIN o ON o.k = l.l_orderkey"""),
    # a quarter of the patients register twice: overlapping at one practice, or at the next one after a gap
    ("registration", f"""SELECT CAST(c_custkey AS VARCHAR) AS alf_pe, CAST(c_nationkey AS VARCHAR) AS prac_cd_pe,
        {S0} AS start_date, if(c_custkey % 4 = 0, {S0} + CAST(c_custkey * 13 % {FX.SPLIT_DAYS} AS INTEGER), {S1}) AS end_date FROM customer
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR), CAST(if(c_custkey % 8 = 0, c_nationkey, (c_nationkey + 1) % 25) AS VARCHAR),
        {S0} + CAST(c_custkey * 13 % {FX.SPLIT_DAYS} + if(c_custkey % 8 = 0, -{FX.REJOIN_DAYS}, {FX.GAP_DAYS}) AS INTEGER), {S1}
        FROM customer WHERE c_custkey % 4 = 0"""),
    ("ethnicity", """SELECT CAST(c_custkey AS VARCHAR) AS alf_pe, CAST(c_nationkey % 6 + 1 AS INTEGER)
        AS ethn_ec_ons_date_latest_code FROM customer WHERE c_custkey % 3 = 0"""),
    ("practice_rate", """SELECT CAST(s_nationkey AS VARCHAR) AS prac_cd_pe, round(avg(s_acctbal) / 1000, 3) AS abx_presc_rt
        FROM supplier GROUP BY s_nationkey"""),
]

any_resistant = "'Resistant' IN (" + ", ".join(c for names in V.DRUGS for c in names) + ")"
YEAR_ON = addm("diag_date", P.followup_months)
OLDEST = addm("wob", 12 * P.max_age_years)

# The baseline stage: facts of a patient, each from its own aggregate, put together at the end.
BASELINE = [
    ("eligible", f"""SELECT cohort1.*, CAST(death_dt AS DATE) AS dod, {YEAR_ON} AS year_on, {OLDEST} AS oldest,
        wob + {P.max_age_years} AS oldest_in_days
        FROM cohort1 LEFT JOIN deaths USING (alf_pe) WHERE pabx = 0 AND wimd_2019_quintile IS NOT NULL"""),
    # the ways to leave, in the order in which they are tried
    ("ways", f"""SELECT *,
        [year_on < oldest AND year_on < gp_end_date AND (dod IS NULL OR oldest_in_days < dod),
         gp_end_date < oldest AND (gp_end_date < dod - 1
             OR (dod IS NULL AND year(gp_end_date) BETWEEN {P.study_start.year} AND {P.study_end.year})),
         dod <= least(gp_end_date + 1, oldest) AND gp_end_date IS NOT NULL,
         oldest < gp_end_date AND (dod IS NULL OR oldest_in_days < dod)] AS way,
        [year_on, gp_end_date, dod, oldest] AS day
        FROM eligible"""),
    ("leaving", f"""SELECT * EXCLUDE (way, day),
        coalesce(day[list_position(way, true)], {S1}) AS cohort_end_dt,
        coalesce([{q(V.TWELVE_MONTHS)}, {q(V.LEFT)}, {q(V.DIED)}, {q(V.LEFT)}][list_position(
            [way[1] AND day[1] <= {S1}, way[2] AND day[2] <= {S1}, way[3] AND day[3] <= {S1}, way[4] AND day[4] <= {S1}], true)],
            {q(V.STUDY_END)}) AS cohort_end_reason
        FROM ways"""),
    ("exposed_before", f"""SELECT DISTINCT alf_pe FROM cohort1 JOIN exposure_ends USING (alf_pe)
        WHERE (alt_end_dt_comb < diag_date AND diag_date < {addm('alt_end_dt_comb', P.prior_exposure_months)})
           OR (pabx_after_ruti <= diag_date AND diag_date <= alt_end_dt_comb)"""),
    ("contacts", f"""SELECT alf_pe, CAST(count(DISTINCT event_dt) AS INTEGER) AS days FROM gp_events JOIN cohort1 USING (alf_pe)
        WHERE event_dt > diag_date AND event_dt <= {addm('diag_date', 12 * P.contact_window_years)}
          AND (regexp_matches(event_cd, '^[0-9]') OR event_cd[1] <> lower(event_cd[1]))
        GROUP BY alf_pe"""),
    # an episode of exposure: its first script and its last end
    ("episodes", """SELECT * FROM (SELECT alf_pe, pabx_str, min(alt_str_dt) AS script FROM exposure_starts GROUP BY ALL)
        JOIN (SELECT alf_pe, pabx_str, max(alt_end_dt_comb) AS last_end FROM exposure_ends GROUP BY ALL) USING (alf_pe, pabx_str)"""),
    ("doses", """SELECT alf_pe, event_dt AS pabx_str, count(DISTINCT (antibx_category, dose, dose_consistency)) > 1 AS mixed,
        min(dose) AS dose, min(dose_consistency) AS steady FROM prescriptions WHERE event_in_grp = 3 GROUP BY alf_pe, event_dt"""),
    ("treated", """SELECT l.*, l.pabx_after_ruti AS pabx_str, CAST(l.pabx_after_ruti - l.diag_date AS INTEGER) AS days_to_pabx,
        e.script AS first_abx_dt, e.last_end AS pabx_end,
        if(d.mixed, 'Multi', d.dose) AS dose, if(d.mixed, 'Multi', d.steady) AS dose_consistency
        FROM leaving l ANTI JOIN exposed_before USING (alf_pe)
        LEFT JOIN episodes e ON e.alf_pe = l.alf_pe AND e.pabx_str = l.pabx_after_ruti
        LEFT JOIN doses d ON d.alf_pe = l.alf_pe AND d.pabx_str = l.pabx_after_ruti"""),
    ("following", """SELECT alf_pe, min(s.pabx_str) FILTER (s.pabx_str > t.pabx_end) AS next_pabx_str,
        min(s.pabx_str) FILTER (s.pabx_str >= t.diag_date) AS pabx_str_all
        FROM treated t JOIN exposure_starts s USING (alf_pe) GROUP BY alf_pe"""),
    ("rate", """SELECT alf_pe, min(CAST(CAST(abx_presc_rt AS DECIMAL(5, 3)) AS DOUBLE)) AS gp_presc_rt
        FROM cohort1 JOIN registration USING (alf_pe) JOIN practice_rate USING (prac_cd_pe)
        WHERE start_date <= diag_date AND diag_date <= end_date GROUP BY alf_pe"""),
    ("resisted", f"""SELECT DISTINCT alf_pe FROM urine_tests JOIN cohort1 USING (alf_pe)
        WHERE {any_resistant} AND diag_date - spcm_collected_dt BETWEEN 0 AND {P.resistance_lookback_days}"""),
    # episodes of general practice that not all hospital episodes of the patient cover
    ("gp_own", """SELECT g.* FROM (SELECT DISTINCT * FROM gp_uti) g LEFT JOIN hosp_uti h USING (alf_pe) GROUP BY ALL
        HAVING bool_and(g.event_str_dt > h.event_str_dt AND g.event_str_dt <= h.event_end_dt) IS NOT TRUE"""),
    ("utis", f"""SELECT alf_pe,
        CAST(count(DISTINCT (event_str_dt, event_end_dt)) FILTER (part = 'gp' AND began) AS INTEGER) AS at_gp,
        CAST(count(DISTINCT (event_str_dt, event_end_dt)) FILTER (part = 'hospital' AND (began OR ended)) AS INTEGER) AS at_hospital
        FROM (SELECT u.*, event_str_dt BETWEEN {addm('diag_date', -12 * P.uti_lookback_years)} AND diag_date AS began,
                     event_end_dt BETWEEN {addm('diag_date', -12 * P.uti_lookback_years)} AND diag_date AS ended
              FROM (SELECT *, 'gp' AS part FROM gp_own UNION ALL SELECT *, 'hospital' FROM hosp_uti) u JOIN cohort1 USING (alf_pe))
        GROUP BY alf_pe"""),
    ("pre", f"""SELECT t.* EXCLUDE (ethnic, cohort_end_reason, year_on, oldest, oldest_in_days),
        coalesce(t.ethnic, ethn_ec_ons_date_latest_code) AS ethnic, coalesce(c.days, 0) AS gp_int_days,
        f.next_pabx_str, f.pabx_str_all, a.script AS pabx_all_first_script, a.last_end AS pabx_end_all, gp_presc_rt,
        CASE WHEN t.alf_pe IN (FROM resisted) THEN 1 ELSE 0 END AS amr_baseline,
        if(f.next_pabx_str < list_min([t.dod, t.gp_end_date, {S1}, t.year_on]) AND t.gp_end_date IS NOT NULL,
           {q(V.NEW)}, t.cohort_end_reason) AS cohort_end_reason,
        if(t.dod < t.year_on AND (NOT (f.next_pabx_str < list_min([t.dod, t.gp_end_date, {S1}, t.year_on])
                                       AND t.gp_end_date IS NOT NULL)) IS NOT FALSE AND t.cohort_end_reason = {q(V.DIED)},
           t.dod, list_min([t.gp_end_date, t.dod, {S1}, f.next_pabx_str, t.year_on])) AS min_end_dt,
        nullif(u.at_gp, 0) AS gp_uti_pre, nullif(u.at_hospital, 0) AS pedw_uti_pre
        FROM treated t LEFT JOIN ethnicity USING (alf_pe) LEFT JOIN contacts c USING (alf_pe) LEFT JOIN following f USING (alf_pe)
        LEFT JOIN episodes a ON a.alf_pe = t.alf_pe AND a.pabx_str = f.pabx_str_all
        LEFT JOIN rate r ON r.alf_pe = t.alf_pe LEFT JOIN utis u ON u.alf_pe = t.alf_pe"""),
]


def with_ctes(final: str, *groups) -> str:
    ctes = []
    for g in (ROLES, BASELINE, *groups):
        ctes += [f"{name} AS (\n    {body}\n)" for name, body in g]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final
