"""Series behind the charts (C1).  Drawing is left to the caller; these are
the long tables a plotting tool reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import fixed
from cohortlens import spec as S
from cohortlens.spec import CohortSpec


def retention_chart_series(curve: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Chart 1: curve points per build, with the headline days flagged for
    labels."""
    return curve.select(
        "version", "cohort_day", "retention_pct",
        F.col("cohort_day").isin(*spec.days).alias("labelled"),
    )


def funnel_chart_series(funnel: DataFrame, spec: CohortSpec = CohortSpec(),
                        max_level: int = fixed.REPORT_MAX_LEVEL,
                        callout_level: int = fixed.BREAK_LEVEL) -> DataFrame:
    """Chart 2: completion and attempts per user by level up to
    ``max_level``, the break level flagged for the callout."""
    bt, ct = spec.base_tag, spec.cand_tag
    return funnel.filter(F.col(S.LEVEL) <= max_level).select(
        S.LEVEL, f"comp_{bt}", f"comp_{ct}", f"att_{bt}", f"att_{ct}",
        (F.col(S.LEVEL) == callout_level).alias("callout"),
    )
