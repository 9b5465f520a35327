"""Column expressions shared by every report.  No UDFs: all of these stay
JVM-side and inside whole-stage codegen.

Numeric conventions (kept identical to the SQL oracle):

* ratios are DOUBLE (``F.lit(100.0)`` is a double literal; the SQL text
  ``100.0`` would be a decimal in Spark);
* a zero denominator gives NULL, never an error (``try_divide``);
* rounding scales first and rounds half away from zero on the scaled double
  (``round_scaled``), which is what ``ROUND(double, p)`` does in the oracle.
  Spark's own ``round`` rounds the decimal text of the double instead and
  disagrees on values such as 0.285.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_scaled(c: Column | str, places: int) -> Column:
    """ROUND(x, places) computed on the scaled double, half away from zero."""
    scale = float(10 ** places)
    return F.round(_col(c) * F.lit(scale), 0) / F.lit(scale)


def round_even(c: Column | str) -> Column:
    """Round to a whole number, ties to even, as a BIGINT."""
    return F.bround(_col(c), 0).cast("bigint")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den))


def pct(num: Column | str, den: Column | str) -> Column:
    """100 * num / den as DOUBLE; NULL when den is 0 or NULL."""
    return F.try_divide(_col(num) * F.lit(100.0), _col(den))


def sum_if(value: Column | str, cond: Column) -> Column:
    """SUM(value) FILTER (WHERE cond): NULL when no row qualifies."""
    return F.sum(F.when(cond, _col(value)))


def max_if(value: Column | str, cond: Column) -> Column:
    return F.max(F.when(cond, _col(value)))


def min_if(value: Column | str, cond: Column) -> Column:
    return F.min(F.when(cond, _col(value)))


def count_if(cond: Column) -> Column:
    """Number of rows where cond holds; 0 (not NULL) when none do."""
    return F.count(F.when(cond, F.lit(1)))


def two_proportion_z(x1: Column | str, n1: Column | str,
                     x2: Column | str, n2: Column | str) -> Column:
    """Pooled two-proportion z statistic of x1/n1 against x2/n2 (unrounded);
    NULL when a sample is empty or the pooled variance is not positive."""
    x1, n1, x2, n2 = (_col(c).cast("double") for c in (x1, n1, x2, n2))
    p1 = F.try_divide(x1, n1)
    p2 = F.try_divide(x2, n2)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    return F.try_divide(p1 - p2, pooled_se(pooled, n1, n2))


def pooled_se(pooled: Column, n1: Column, n2: Column) -> Column:
    """sqrt(p (1 - p) (1/n1 + 1/n2)); NULL unless the variance is positive."""
    var = (pooled * (F.lit(1.0) - pooled)
           * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.when(var > 0, F.sqrt(var))
