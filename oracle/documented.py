"""The stated intent in SQL: the rules of the other modules with the clauses that differ put in their place."""

from __future__ import annotations

from oracle import values as V
from oracle.roles import OLDEST
from oracle.stages import _culture_value, _drugs_resisted, _g
from trialspark.params import FIXTURE_PARAMS as P

#: By difference: the clause as written, and as documented.
CLAUSES = {
    "D1": (f"wob + {P.max_age_years} AS oldest_in_days", f"{OLDEST} AS oldest_in_days"),
    "D4": ("outcome_dt < next_pabx_str", "outcome_dt <= next_pabx_str"),
    "D5": (f"{_culture_value}[min(", f"{[*[v for _, v in V.CULTURES][:-2], 3, 3]}[min("),
    "D6": ("SEMI JOIN resistant_stays USING (alf_pe, prov_unit_cd, spell_num_pe)",
           "SEMI JOIN resistant_stays USING (alf_pe, prov_unit_cd, spell_num_pe, epi_num)"),
    "D8": (_drugs_resisted, " + ".join(f"max(CASE WHEN 'Resistant' IN ({', '.join(names)}) THEN 1 ELSE 0 END)" for names in V.DRUGS)),
    "D9": ("""SELECT g.* FROM (SELECT DISTINCT * FROM gp_uti) g LEFT JOIN hosp_uti h USING (alf_pe) GROUP BY ALL
        HAVING bool_and(g.event_str_dt > h.event_str_dt AND g.event_str_dt <= h.event_end_dt) IS NOT TRUE""",
           """SELECT DISTINCT * FROM gp_uti g WHERE NOT EXISTS (SELECT 1 FROM hosp_uti h
        WHERE h.alf_pe = g.alf_pe AND g.event_str_dt > h.event_str_dt AND g.event_str_dt <= h.event_end_dt)"""),
    "D16": (f"CASE WHEN place <= 4 THEN place WHEN place <= {_g} AND place < n THEN place + 1 END AS c0",
            f"CASE WHEN place <= {_g} + 1 THEN place END AS c0"),
}


def as_documented(sql: str, *differences: str) -> str:
    """``sql`` with every documented clause; those named must be in it."""
    for name in differences:
        if CLAUSES[name][0] not in sql:
            raise ValueError(f"{name} is not in the query")
    for written, documented in CLAUSES.values():
        sql = sql.replace(written, documented)
    return sql
