"""Planted faults: cells with every fault that the integrity checks look for.

A check whose answer is zero on clean cells shows nothing.  ``with_faults``
changes cells by a rule over their own keys, so the same cells get the same
fault on any engine, in any order and any partitioning; the SQL twin of the
rule is ``plans.oracle.FAULT_CTES``.

``fault_code`` spreads cells over ``PERIOD`` codes.  Activity cells of a few
codes are: written twice; given negative sessions; left out (their progression
becomes an orphan, and a day 0 left out makes a bad cohort); emptied of
playtime; given more than a day of playtime a user; moved to a cohort day after
the extract; or grown beyond their day 0.  Progression cells: written twice;
given a start that neither ended nor failed; given negative level seconds;
given more users than starts; or moved to a country without activity.

All are projections and filters of one scan (a doubled cell is exploded from
an array of two), so they add no shuffle and no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import spec as S

PERIOD = 97
LATE_DAYS = 5000       # a cohort day this much later is after any extract
NOWHERE = "NOWHERE"    # a country without activity

# Fault codes of activity cells.
TWICE, NEGATIVE, LEFT_OUT, NO_PLAYTIME, LONG_PLAYTIME, LATE, GROWN = 1, 2, 3, 4, 5, 6, 7
# Fault codes of progression cells (TWICE and NEGATIVE as above).
BREAK, MANY_USERS, MOVED = 13, 14, 15


def fault_code(level: bool = False) -> Column:
    """0 .. PERIOD - 1 from a cell's keys (``level``: of a progression cell)."""
    day = F.datediff(F.col(S.INSTALL_DATE), F.lit("1970-01-01").cast("date"))
    texts = [F.length(c) * F.lit(k) + F.ascii(c) * F.lit(k + 2)
             for k, c in ((3, S.VERSION), (5, S.COUNTRY), (11, S.NETWORK), (17, S.PACKAGE))]
    code = day * 7 + F.col(S.COHORT_DAY) * 13
    for t in texts:
        code = code + t
    if level:
        code = code + F.col(S.LEVEL) * 29
    return F.pmod(code, F.lit(PERIOD)).cast("int")


def _doubled(df: DataFrame, code: Column) -> DataFrame:
    copies = F.when(code == TWICE, F.lit(2)).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def with_activity_faults(act: DataFrame) -> DataFrame:
    """Activity cells with planted faults (a NULL code, of a NULL key, plants none)."""
    code = F.col("_code")
    cells = act.withColumn("_code", F.coalesce(fault_code(), F.lit(0))).filter(code != LEFT_OUT)
    later = (code == GROWN) & (F.col(S.COHORT_DAY) > 0)
    changed = cells.withColumns({
        S.SESSIONS: F.when(code == NEGATIVE, -F.col(S.SESSIONS)).otherwise(F.col(S.SESSIONS)),
        S.PLAYTIME: F.when(code == NO_PLAYTIME, 0.0)
        .when(code == LONG_PLAYTIME, F.col(S.ACTIVE) * 90_000.0).otherwise(F.col(S.PLAYTIME)),
        S.COHORT_DAY: F.when(code == LATE, F.col(S.COHORT_DAY) + LATE_DAYS)
        .otherwise(F.col(S.COHORT_DAY)),
        S.ACTIVE: F.when(later, F.col(S.ACTIVE) * 50).otherwise(F.col(S.ACTIVE)),
    })
    return _doubled(changed, code).select(*act.columns)


def with_progression_faults(prog: DataFrame) -> DataFrame:
    """Progression cells with planted faults."""
    code = F.col("_code")
    cells = prog.withColumn("_code", F.coalesce(fault_code(level=True), F.lit(0)))
    changed = cells.withColumns({
        S.STARTED: F.when(code == BREAK, F.col(S.STARTED) + 1).otherwise(F.col(S.STARTED)),
        S.LEVEL_TIME: F.when(code == NEGATIVE, -F.col(S.LEVEL_TIME)).otherwise(F.col(S.LEVEL_TIME)),
        S.USERS: F.when(code == MANY_USERS, F.col(S.STARTED) + 5).otherwise(F.col(S.USERS)),
        S.COUNTRY: F.when(code == MOVED, F.lit(NOWHERE)).otherwise(F.col(S.COUNTRY)),
    })
    return _doubled(changed, code).select(*prog.columns)


def with_faults(act: DataFrame, prog: DataFrame) -> tuple[DataFrame, DataFrame]:
    return with_activity_faults(act), with_progression_faults(prog)


# Fault codes of CSV records: a word for a number, a date that is none, a fraction
# for a whole number, an empty key.
WORD, NO_DATE, FRACTION, EMPTY_KEY = 21, 22, 23, 24


def csv_with_bad_records(act: DataFrame) -> DataFrame:
    """Activity cells as text columns, some records bad by the rule of their keys."""
    code = F.coalesce(fault_code(), F.lit(0))
    text = {c: F.col(c).cast("string") for c in act.columns}
    text[S.PLAYTIME] = F.when(code == WORD, "n/a").otherwise(text[S.PLAYTIME])
    text[S.INSTALL_DATE] = F.when(code == NO_DATE, "some day").otherwise(text[S.INSTALL_DATE])
    text[S.SESSIONS] = F.when(code == FRACTION, F.concat(text[S.SESSIONS], F.lit(".5"))).otherwise(text[S.SESSIONS])
    text[S.COUNTRY] = F.when(code != EMPTY_KEY, text[S.COUNTRY])
    return act.select(*[text[c].alias(c) for c in act.columns])
