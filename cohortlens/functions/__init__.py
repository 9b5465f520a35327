"""Column expressions (rounding, ratios, conditional aggregates, z test)."""

from cohortlens.functions.exprs import (
    count_if,
    max_if,
    min_if,
    pct,
    pooled_se,
    ratio,
    round_even,
    round_scaled,
    sum_if,
    two_proportion_z,
)

__all__ = [
    "count_if", "max_if", "min_if", "pct", "pooled_se", "ratio", "round_even",
    "round_scaled", "sum_if", "two_proportion_z",
]
