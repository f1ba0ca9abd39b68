"""The sixteen logical input tables the study reads, bound to DataFrames.

Operators never read files; they take a :class:`SourceCatalog`. Column names are
the study's (lower case). ``normalise`` applies the boundary rules once: dates
become ``DateType`` and string codes lose trailing blanks (a fixed-width store
compares ``'X '`` equal to ``'X'``; Spark does not).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# columns each logical table must provide (FIXTURES.md A)
REQUIRED = {
    "cohort": ["alf_pe", "diag_date", "wob", "agediag", "gp_end_date", "wimd_2019_quintile", "ethnic",
               "pabx", "pabx_after_ruti"],
    "deaths": ["alf_pe", "death_dt"],
    "exposure_ends": ["alf_pe", "pabx_str", "alt_end_dt_comb"],
    "exposure_starts": ["alf_pe", "pabx_str", "alt_str_dt", "alt_abx_type"],
    "prescriptions": ["alf_pe", "event_dt", "event_in_grp", "antibx_category", "dose", "dose_consistency"],
    "gp_events": ["alf_pe", "event_dt", "event_cd"],
    "ethnicity": ["alf_pe", "ethn_ec_ons_date_latest_code"],
    "registration": ["alf_pe", "prac_cd_pe", "start_date", "end_date"],
    "practice_rate": ["prac_cd_pe", "abx_presc_rt"],
    "urine_tests": ["alf_pe", "spcm_collected_dt", "report_seq", "request_seq", "uti_outcome"],
    "gp_uti": ["alf_pe", "event_str_dt", "event_end_dt", "data_source"],
    "hosp_uti": ["alf_pe", "event_str_dt", "event_end_dt", "data_source"],
    "all_uti": ["alf_pe", "event_str_dt"],
    "spell": ["alf_pe", "prov_unit_cd", "spell_num_pe", "admis_dt", "disch_dt"],
    "episode": ["prov_unit_cd", "spell_num_pe", "epi_num", "epi_str_dt", "epi_end_dt"],
    "diagnosis": ["prov_unit_cd", "spell_num_pe", "epi_num", "diag_cd_1234"],
}

# string code columns compared with '=' / IN / LIKE somewhere in the study
_CODE_COLUMNS = {"alf_pe", "event_cd", "diag_cd_1234", "uti_outcome", "data_source", "prac_cd_pe",
                 "prov_unit_cd", "alt_abx_type", "dose", "dose_consistency", "antibx_category"}


@dataclasses.dataclass
class SourceCatalog:
    cohort: DataFrame
    deaths: DataFrame
    exposure_ends: DataFrame
    exposure_starts: DataFrame
    prescriptions: DataFrame
    gp_events: DataFrame
    ethnicity: DataFrame
    registration: DataFrame
    practice_rate: DataFrame
    urine_tests: DataFrame
    gp_uti: DataFrame
    hosp_uti: DataFrame
    all_uti: DataFrame
    spell: DataFrame
    episode: DataFrame
    diagnosis: DataFrame

    def validate(self) -> "SourceCatalog":
        for name, cols in REQUIRED.items():
            have = set(getattr(self, name).columns)
            missing = [col for col in cols if col not in have]
            if missing:
                raise ValueError(f"source {name!r} lacks columns {missing}")
        return self

    def normalised(self) -> "SourceCatalog":
        return SourceCatalog(**{f.name: normalise(getattr(self, f.name)) for f in dataclasses.fields(self)})


def normalise(df: DataFrame) -> DataFrame:
    """Dates to ``DateType``; trailing blanks off code columns. Narrow, no shuffle."""
    exprs = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.to_date(col)
        elif isinstance(field.dataType, T.StringType) and field.name in _CODE_COLUMNS:
            col = F.rtrim(col)
        exprs.append(col.alias(field.name))
    return df.select(*exprs)
