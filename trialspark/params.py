"""Study parameters shared by every operator.

All dates are plain ``datetime.date`` values and become literals in the plan, so
Catalyst can fold them and push them into parquet scans.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from trialspark.functions.codes import RESISTANCE_COLUMNS

AS_WRITTEN = "as_written"
AS_DOCUMENTED = "as_documented"


@dataclasses.dataclass(frozen=True)
class StudyParams:
    study_start: dt.date = dt.date(2015, 1, 1)
    study_end: dt.date = dt.date(2020, 12, 31)
    followup_months: int = 12
    step_days: int = 7
    grace_weeks: int = 12
    max_age_years: int = 120
    # look-backs, kept separate on purpose (they differ in the source: 365 days, 1 year, 12 months)
    resistance_lookback_days: int = 365
    uti_lookback_years: int = 1
    specimen_lookback_years: int = 1
    prior_exposure_months: int = 12
    contact_window_years: int = 1
    # hospital rules
    admission_window_days: int = 2
    discharge_gap_days: int = 3
    # Antibiotics whose resistance counts for the "any" laboratory outcome and at baseline
    antibiotics: tuple[str, ...] = RESISTANCE_COLUMNS
    # weight truncation quantile (type 7)
    weight_q: float = 0.9995
    # bootstrap replicates with fixed weights, and with both weight models fitted anew in each
    bootstrap_replicates: int = 200
    refit_replicates: int = 200
    # "as_written" reproduces the code, "as_documented" the stated intent
    mode: str = AS_WRITTEN

    def __post_init__(self):
        if self.mode not in (AS_WRITTEN, AS_DOCUMENTED):
            raise ValueError(f"mode must be {AS_WRITTEN!r} or {AS_DOCUMENTED!r}")
        if self.step_days < 1:
            raise ValueError("step_days must be positive")

    @property
    def documented(self) -> bool:
        return self.mode == AS_DOCUMENTED

    @property
    def study_years(self) -> tuple[int, int]:
        return self.study_start.year, self.study_end.year


# Window used with the driver's synthetic tables (orders run 1995-2001).
FIXTURE_PARAMS = StudyParams(study_start=dt.date(1996, 1, 1), study_end=dt.date(2000, 12, 31))
