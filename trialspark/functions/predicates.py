"""Row predicates over the study's coded columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.functions import codes
from trialspark.functions.dates import any_of
from trialspark.params import StudyParams


def any_resistant(columns=codes.RESISTANCE_COLUMNS) -> Column:
    """Any of the listed antibiotic columns equals 'Resistant' (SQL OR: NULL columns do not match)."""
    return any_of(F.col(name) == codes.RESISTANT for name in columns)


def resistant_to(column: str) -> Column:
    return F.col(column) == codes.RESISTANT


def counts_as_contact(code: Column) -> Column:
    """GP event code starting with an upper-case letter or a digit."""
    first = F.substring(code, 1, 1)
    return (first != F.lower(first)) | first.isin(*[str(i) for i in range(10)])


def specimen_rank() -> Column:
    """Rank of a specimen's outcome, 1 the best; unlisted outcomes come last."""
    rank_of = F.create_map(*[x for i, o in enumerate(codes.UTI_OUTCOME_RANK, 1) for x in (F.lit(o), F.lit(i))])
    return F.coalesce(F.try_element_at(rank_of, F.col("uti_outcome")), F.lit(len(codes.UTI_OUTCOME_RANK) + 1))


def specimen_indicator(rank: Column, params: StudyParams) -> Column:
    """What the best rank of the day says; NULL for an unlisted outcome."""
    indicator = dict(codes.URINE_INDICATOR_BY_RANK)
    if params.documented:  # D5
        indicator.update({5: codes.URINE_INDICATOR_NO_EVIDENCE_DOCUMENTED, 6: codes.URINE_INDICATOR_NO_EVIDENCE_DOCUMENTED})
    ind_of = F.create_map(*[F.lit(x) for kv in sorted(indicator.items()) for x in kv])
    return F.try_element_at(ind_of, rank).cast("int")
