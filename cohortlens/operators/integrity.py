"""Profile and integrity checks (Q1-Q19).

Cost model: every counter is derived from ``cell_pairs`` -- each table
rolled up to the activity grain once (row-level fault counts ride along as
conditional counts), then paired on it -- followed by a chain of shrinking
aggregates.  All shuffles carry partial aggregates, so a key holding a large
share of the rows costs one combined row per task, not its rows.  The detail
lists (orphans, duplicates, bad cohorts) are filters or small rollups of the
same pairs.

Counts are 0, never NULL, on clean data.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import fixed
from cohortlens import spec as S
from cohortlens.functions import count_if, max_if, round_scaled, sum_if
from cohortlens.operators.window import AnalysisWindow, comparable, two_builds
from cohortlens.spec import CohortSpec

SECONDS_PER_DAY = fixed.SECONDS_PER_DAY
TIME_TOLERANCE = fixed.LEVEL_TIME_TOLERANCE   # level time may exceed session time by 0.1 %


def _c(name: str) -> Column:
    return F.col(name)


def version_profile(act: DataFrame, row_count: str | None = None) -> DataFrame:
    """Q1: per build label: rows, first and last install, day-0 users.

    ``row_count`` names a column holding cell counts when ``act`` is a
    rollup rather than the cells themselves."""
    rows = F.sum(row_count) if row_count else F.count(F.lit(1))
    return act.groupBy(S.VERSION).agg(
        rows.alias("n_rows"),
        F.min(S.INSTALL_DATE).alias("first_install"),
        F.max(S.INSTALL_DATE).alias("last_install"),
        sum_if(_c(S.ACTIVE), _c(S.COHORT_DAY) == 0).alias("d0_users"),
    )


# --- key-level checks -------------------------------------------------------

def activity_grain(act: DataFrame) -> DataFrame:
    """Activity rows per grain key (KEY6 -> n)."""
    return act.groupBy(*S.KEY6).agg(F.count(F.lit(1)).alias("n"))


def progression_grain(prog: DataFrame) -> DataFrame:
    """Progression rows and summed level seconds per activity grain key."""
    return prog.groupBy(*S.KEY6).agg(
        F.count(F.lit(1)).alias("n"), F.sum(S.LEVEL_TIME).alias("level_seconds"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q5/Q6 detail: grain keys occurring more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


class IntegrityError(RuntimeError):
    """A check that must be zero is not."""


def assert_clean(report: DataFrame, checks: tuple[str, ...] = ("identity_breaks",)) -> None:
    """Stop the run when any of ``checks`` is non-zero in an integrity
    report (the report is a handful of rows; this is its only action)."""
    found = {r["check_name"]: r["n"] for r in
             report.filter(F.col("check_name").isin(*checks)).collect()}
    unknown = [c for c in checks if c not in found]
    if unknown:
        raise ValueError(f"unknown integrity checks: {unknown}")
    bad = {c: n for c, n in found.items() if n}
    if bad:
        raise IntegrityError(f"integrity checks failed: {bad}")


def bad_cohort_cells(act: DataFrame) -> DataFrame:
    """Q8 detail: cohorts whose day-0 row is missing or zero, or with a later
    day larger than day 0."""
    u, cd = _c(S.ACTIVE), _c(S.COHORT_DAY)
    return (act.groupBy(*S.KEY5)
            .agg(sum_if(u, cd == 0).alias("d0"), max_if(u, cd > 0).alias("later"))
            .filter(F.col("d0").isNull() | (F.col("d0") == 0) | (F.col("later") > F.col("d0"))))


def orphan_cells(left_grain: DataFrame, right_grain: DataFrame) -> DataFrame:
    """Q9/Q10 detail: distinct grain keys of ``left`` absent from ``right``.
    NULL keys never match, so they count as orphans."""
    return (left_grain.select(*S.KEY6)
            .join(right_grain.select(*S.KEY6), on=S.KEY6, how="left_anti"))


def orphan_prog_cells(pairs: DataFrame) -> DataFrame:
    """Q9 detail from the grain pairs: progression cells without activity."""
    return pairs.filter(F.col("a_rows").isNull()).select(*S.KEY6)


def orphan_act_cells(pairs: DataFrame) -> DataFrame:
    """Q10 detail from the grain pairs: activity cells without progression."""
    return pairs.filter(F.col("p_rows").isNull()).select(*S.KEY6)


def duplicate_act_keys(pairs: DataFrame) -> DataFrame:
    """Q5 detail from the grain pairs: activity keys with more than one row."""
    return pairs.filter(F.col("a_rows") > 1).select(*S.KEY6, F.col("a_rows").alias("n"))


#: At most so many flagged keys (six short values each) are broadcast.
BROADCAST_KEYS = 100_000


def flagged_keys(pairs: DataFrame) -> DataFrame:
    """Activity keys under which a level may be duplicated (see ``cell_pairs``)."""
    return pairs.filter(F.col("p_dup_suspect")).select(*S.KEY6)


def duplicate_prog_keys(prog: DataFrame, pairs: DataFrame, n_flagged: int | None = None
                        ) -> DataFrame:
    """Q6 detail: progression keys (KEY7) with more than one row.

    Only progression rows under the keys that the grain pairs flag (normally
    none) are regrouped, by a semi join, instead of shuffling every row by
    KEY7.  The join is null-safe because GROUP BY treats NULL key parts as
    equal.  With ``n_flagged``, ``pairs`` is the written table of
    ``flagged_keys`` and its row count: none means that progression is not
    read at all, up to ``BROADCAST_KEYS`` are broadcast, so that progression
    is filtered before any shuffle, and beyond that both sides are shuffled."""
    if n_flagged == 0:
        return duplicate_keys(prog.filter(F.lit(False)), S.KEY7)
    flagged = flagged_keys(pairs) if n_flagged is None else pairs
    cond = [prog[c].eqNullSafe(flagged[c]) for c in S.KEY6]
    if n_flagged is not None and n_flagged <= BROADCAST_KEYS:
        flagged = F.broadcast(flagged)
    return duplicate_keys(prog.join(flagged, on=cond, how="left_semi"), S.KEY7)


def rows_beyond_extract(cells: DataFrame, extract: dt.date) -> DataFrame:
    """Q7 on either table: rows whose install date plus cohort day falls
    after the extract (an impossible future row).  One global aggregate."""
    beyond = F.date_add(_c(S.INSTALL_DATE), _c(S.COHORT_DAY).cast("int")) > F.lit(extract)
    return cells.agg(count_if(beyond).alias("rows_beyond_extract"))


def missing_cohort_days(act: DataFrame, extract: dt.date,
                        spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Q11 detail: for each (build, install date) of the two builds, the
    expected cohort days 0 .. min(horizon, extract - date) that have no row.

    The expected days are generated per (build, date) row (<= horizon + 1
    each), never by crossing two tables."""
    have = (two_builds(act, spec)
            .select(S.VERSION, S.INSTALL_DATE, S.COHORT_DAY).distinct())
    last = F.least(F.lit(spec.horizon), F.datediff(F.lit(extract), _c(S.INSTALL_DATE)))
    expect = (have.select(S.VERSION, S.INSTALL_DATE).distinct()
              .withColumn(S.COHORT_DAY, F.explode(F.sequence(F.lit(0), last)))
              .withColumn(S.COHORT_DAY, F.col(S.COHORT_DAY).cast("bigint")))
    return expect.join(have, on=[S.VERSION, S.INSTALL_DATE, S.COHORT_DAY], how="left_anti")


def install_date_gaps(act: DataFrame) -> DataFrame:
    """Q15: per build, calendar days between first and last install that
    have no install, summed over builds."""
    per_build = (act.select(S.VERSION, S.INSTALL_DATE).distinct()
                 .groupBy(S.VERSION)
                 .agg((F.datediff(F.max(S.INSTALL_DATE), F.min(S.INSTALL_DATE)) + 1
                       - F.count(F.lit(1))).alias("gap")))
    return per_build.agg(F.coalesce(F.sum("gap"), F.lit(0)).cast("bigint").alias("n"))


def extract_day_check(act: DataFrame, extract: dt.date,
                      spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Q16: day-0 users installed on the extract day and on the day before
    (a half-day extract would show as a short last cohort)."""
    u, d = _c(S.ACTIVE), _c(S.INSTALL_DATE)
    base = two_builds(act, spec).filter(_c(S.COHORT_DAY) == 0)
    return base.agg(
        sum_if(u, d == F.lit(extract)).alias("d0_last_day"),
        sum_if(u, d == F.date_sub(F.lit(extract), 1)).alias("d0_prev_day"),
    )


def _quirk_flag(level_seconds: Column, session_seconds: Column) -> Column:
    return level_seconds > session_seconds * F.lit(TIME_TOLERANCE)


def _level_seconds(prog: DataFrame | None, pairs: DataFrame | None) -> DataFrame:
    """Summed level seconds per activity grain key, from the pairs if given."""
    if pairs is not None:
        return pairs.filter(F.col("p_rows").isNotNull()).select(*S.KEY6, "level_seconds")
    return progression_grain(prog).select(*S.KEY6, "level_seconds")


def playtime_quirk_cells(act: DataFrame, prog: DataFrame | None = None,
                         pairs: DataFrame | None = None) -> DataFrame:
    """Q17 detail: activity cells whose summed level seconds exceed their
    session seconds by more than 0.1 %."""
    p = _level_seconds(prog, pairs)
    return (act.join(p, on=S.KEY6, how="inner")
            .filter(_quirk_flag(F.col("level_seconds"), _c(S.PLAYTIME))))


def quirk_cells_from_pairs(pairs: DataFrame, act: DataFrame,
                           n_duplicated: int) -> DataFrame:
    """Q17 detail from the grain pairs, without a join of the activity rows.

    A key that one activity row has holds that row's measures in its sums, so
    the quirk is a filter of the pairs.  Only rows under keys that more than
    one row has (``n_duplicated`` such keys, normally none) are read from the
    activity cells, by a join to those keys, broadcast up to
    ``BROADCAST_KEYS`` of them."""
    both = pairs.filter(F.col("p_rows").isNotNull())
    single = both.filter(F.col("a_rows") == 1).select(
        *S.KEY6, F.col("a_users").alias(S.ACTIVE), F.col("a_sessions").alias(S.SESSIONS),
        F.col("a_playtime").alias(S.PLAYTIME), "level_seconds")
    cells = single
    if n_duplicated:
        keys = both.filter(F.col("a_rows") > 1).select(*S.KEY6, "level_seconds")
        if n_duplicated <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        cells = single.unionByName(act.join(keys, on=S.KEY6, how="inner"))
    return cells.filter(_quirk_flag(F.col("level_seconds"), _c(S.PLAYTIME)))


def playtime_quirk(act: DataFrame, prog: DataFrame | None = None,
                   pairs: DataFrame | None = None) -> DataFrame:
    """Q17: count of such cells, all cells, mean time ratio, mean actives,
    user-days touched and all user-days.

    One left join of every activity row to the progression rollup (unique per
    key, so rows are neither lost nor repeated) and one aggregate: the totals
    and the flagged subset come from the same pass, without a cross join."""
    p = _level_seconds(prog, pairs)
    j = act.join(p, on=S.KEY6, how="left")
    flag = _quirk_flag(F.col("level_seconds"), _c(S.PLAYTIME))
    u = _c(S.ACTIVE)
    return j.agg(
        count_if(flag).alias("anomalous_cells"),
        F.count(F.lit(1)).alias("total_cells"),
        round_scaled(F.avg(F.when(flag, F.try_divide(F.col("level_seconds"), _c(S.PLAYTIME)))), 2)
        .alias("avg_ratio"),
        round_scaled(F.avg(F.when(flag, u)), 1).alias("avg_cell_actives"),
        sum_if(u, flag).alias("user_days_touched"),
        F.sum(u).alias("user_days_total"),
    )


def playtime_quirk_from(flagged: DataFrame, totals_from: DataFrame,
                        row_count: str | None = None) -> DataFrame:
    """Q17 from already flagged cells (``playtime_quirk_cells``) plus the
    totals of all cells, taken from ``totals_from`` (the cells, or a rollup
    whose ``row_count`` column counts them).  Equal to ``playtime_quirk``
    without a second join of every activity row.

    The two one-row aggregates are stacked and folded with MAX, each column
    being set in exactly one of them; no cross join."""
    u = _c(S.ACTIVE)
    part = flagged.agg(
        F.count(F.lit(1)).alias("anomalous_cells"),
        F.lit(None).cast("bigint").alias("total_cells"),
        F.avg(F.try_divide(F.col("level_seconds"), _c(S.PLAYTIME))).alias("_ratio"),
        F.avg(u).alias("_actives"),
        F.sum(u).alias("user_days_touched"),
        F.lit(None).cast("bigint").alias("user_days_total"),
    )
    rows = F.sum(row_count) if row_count else F.count(F.lit(1))
    whole = totals_from.agg(
        F.lit(None).cast("bigint").alias("anomalous_cells"),
        rows.cast("bigint").alias("total_cells"),
        F.lit(None).cast("double").alias("_ratio"),
        F.lit(None).cast("double").alias("_actives"),
        F.lit(None).cast("bigint").alias("user_days_touched"),
        F.sum(u).cast("bigint").alias("user_days_total"),
    )
    both = part.unionByName(whole).agg(
        F.max("anomalous_cells").alias("anomalous_cells"),
        F.max("total_cells").alias("total_cells"),
        F.max("_ratio").alias("_ratio"), F.max("_actives").alias("_actives"),
        F.max("user_days_touched").alias("user_days_touched"),
        F.max("user_days_total").alias("user_days_total"),
    )
    return both.select(
        "anomalous_cells", "total_cells",
        round_scaled("_ratio", 2).alias("avg_ratio"),
        round_scaled("_actives", 1).alias("avg_cell_actives"),
        "user_days_touched", "user_days_total",
    )


def zero_playtime_users(u: Column, pt: Column) -> Column:
    """Per cell: its active users if it has actives but no playtime, else 0."""
    return F.when((pt <= 0) & (u > 0), u).otherwise(F.lit(0))


def zero_playtime_actives(act: DataFrame, window: AnalysisWindow,
                          spec: CohortSpec = CohortSpec(),
                          per_cell: str | None = None) -> DataFrame:
    """Q18: per build, active users in cells with no playtime (crash on
    open); 0 when there are none.  ``per_cell`` names a column already
    holding ``zero_playtime_users`` sums when ``act`` is a rollup."""
    value = F.col(per_cell) if per_cell else zero_playtime_users(_c(S.ACTIVE), _c(S.PLAYTIME))
    return comparable(act, window, spec).groupBy(S.VERSION).agg(
        F.sum(value).cast("bigint").alias("actives_zero_playtime"))


# --- the whole report -------------------------------------------------------

def _bit(k: Column) -> Column:
    """2**k as BIGINT (exact for k up to 60)."""
    return F.pow(F.lit(2), k).cast("bigint")


DAYS_PER_MASK = 60   # cohort days per BIGINT mask; a horizon takes as many masks as it needs


def _masks(spec: CohortSpec) -> list[tuple[str, int]]:
    """(column, first cohort day) of each mask of the days 0 .. horizon."""
    return [(f"days_mask_{k}", k * DAYS_PER_MASK)
            for k in range(spec.horizon // DAYS_PER_MASK + 1)]


LEVELS_PER_MASK = 60   # levels per BIGINT mask, a block
MAX_LEVEL_MASKS = 20   # blocks with a mask, those with most rows; keys with levels of others are recounted


def level_blocks(prog: DataFrame) -> list[int]:
    """First levels of the blocks of ``LEVELS_PER_MASK`` levels that hold most progression rows, at
    most ``MAX_LEVEL_MASKS``: one action on one column, partially aggregated to a row per block.

    A stray level far from the others has a block of its own; it takes no mask from theirs."""
    block = F.floor(F.col(S.LEVEL).cast("long") / LEVELS_PER_MASK)
    sizes = prog.where(F.col(S.LEVEL).isNotNull()).groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "block").limit(MAX_LEVEL_MASKS).collect()
    return sorted(r["block"] * LEVELS_PER_MASK for r in most) or [0]


def cell_pairs(act: DataFrame, prog: DataFrame,
               levels: tuple[int, int] | None = None) -> DataFrame:
    """Both tables rolled up to the activity grain and paired on it.

    activity    -> KEY6: rows, summed and max actives, summed sessions and
                   playtime, row-level fault counts;
    progression -> KEY6: rows, fault counts, level seconds, and a flag for
                   groups that may hold a duplicated level key.
    Each table is shuffled once, by KEY6, carrying partial aggregates (a hot
    key costs one combined row per task).  Both rollups come out
    hash-partitioned on KEY6, so the full outer join adds no exchange.  A
    key present on one side only is an orphan of that side; NULL key parts
    never match, as in SQL.

    Duplicate level keys without a KEY7 shuffle: inside a group the levels
    are distinct exactly when the sum of 2**level equals their bitwise OR.
    The masks are those of ``level_blocks``, or run from the first to the last
    of ``levels``, if given.  A second NULL level, levels of no mask and an
    overflowing sum only raise the flag of their own group;
    ``duplicate_prog_keys`` recounts flagged groups exactly.
    """
    firsts = (list(range(levels[0], levels[1] + 1, LEVELS_PER_MASK))[:MAX_LEVEL_MASKS] if levels
              else level_blocks(prog))
    masks = [(f"_{k}", first) for k, first in enumerate(firsts)]
    u, s, pt = _c(S.ACTIVE), _c(S.SESSIONS), _c(S.PLAYTIME)
    a6 = act.groupBy(*S.KEY6).agg(
        F.count(F.lit(1)).alias("a_rows"),
        F.sum(u).alias("a_users"),
        F.max(u).alias("a_users_max"),
        F.sum(s).alias("a_sessions"),
        F.sum(pt).alias("a_playtime"),
        count_if(F.least(u, s, pt) < 0).alias("a_negatives"),
        count_if(s < u).alias("a_sessions_lt_actives"),
        count_if(pt > u * F.lit(SECONDS_PER_DAY)).alias("a_playtime_gt_24h"),
    )
    st, co, fa = _c(S.STARTED), _c(S.COMPLETED), _c(S.FAILED)
    us, lt, lv = _c(S.USERS), _c(S.LEVEL_TIME), _c(S.LEVEL)

    def in_mask(first: int) -> Column:
        return lv.between(first, first + LEVELS_PER_MASK - 1)

    def level_bit(first: int) -> Column:
        return F.when(in_mask(first), _bit(lv - first))

    masked = reduce(or_, (in_mask(first) for _, first in masks))
    p6 = prog.groupBy(*S.KEY6).agg(
        F.count(F.lit(1)).alias("p_rows"),
        count_if(st != co + fa).alias("p_identity_breaks"),
        count_if(F.least(st, co, fa, us, lt) < 0).alias("p_negatives"),
        count_if(us > st).alias("p_users_gt_starts"),
        F.sum(lt).alias("level_seconds"),
        *[F.try_sum(level_bit(first)).alias(f"_bits_sum{k}") for k, first in masks],
        *[F.bit_or(level_bit(first)).alias(f"_bits_or{k}") for k, first in masks],
        count_if(lv.isNull()).alias("_null_levels"),
        count_if(~masked).alias("_odd_levels"),
    )
    suspect = (F.col("_null_levels") > 1) | (F.col("_odd_levels") > 0)
    for k, _ in masks:
        suspect = suspect | ~F.col(f"_bits_sum{k}").eqNullSafe(F.col(f"_bits_or{k}"))
    p6 = p6.withColumn("p_dup_suspect", suspect).drop(
        "_null_levels", "_odd_levels", *[f"_bits_{x}{k}" for k, _ in masks for x in ("sum", "or")])
    return a6.join(p6, on=S.KEY6, how="full_outer")


def integrity_report(act: DataFrame, prog: DataFrame, extract: dt.date,
                     spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Q19: every integrity counter (Q2-Q15) as one (check_name, n) row."""
    return integrity_from_pairs(cell_pairs(act, prog), prog, extract, spec)


COHORT_COUNTERS = ["act_rows", "prog_rows", "identity_breaks", "negatives", "dup_act",
                   "rows_beyond_extract", "prog_cells_without_act", "act_cells_without_prog",
                   "cells_sessions_lt_actives", "cells_playtime_gt_24h", "cells_users_gt_starts"]


def cohort_rollup(pairs: DataFrame, extract: dt.date,
                  spec: CohortSpec = CohortSpec()) -> DataFrame:
    """The grain pairs rolled up to cohorts (KEY5): day-0 and largest later
    actives, bit masks of the cohort days present, and every counter.

    A cohort holds at most one pair per cohort day, so no group is hot here
    even when a key of the cells is."""
    h = spec.horizon
    has_act, has_prog = F.col("a_rows").isNotNull(), F.col("p_rows").isNotNull()
    cd, d = _c(S.COHORT_DAY), _c(S.INSTALL_DATE)
    beyond = F.date_add(d, cd.cast("int")) > F.lit(extract)

    def days(first: int) -> Column:
        last = min(h, first + DAYS_PER_MASK - 1)
        return F.bit_or(F.when(has_act & cd.between(first, last), _bit(cd - first)))
    return pairs.groupBy(*S.KEY5).agg(
        sum_if(F.col("a_users"), has_act & (cd == 0)).alias("d0"),
        max_if(F.col("a_users_max"), has_act & (cd > 0)).alias("later"),
        *[days(first).alias(name) for name, first in _masks(spec)],
        F.max(F.when(has_act, F.lit(1))).alias("has_act"),
        F.sum("a_rows").alias("act_rows"),
        F.sum("p_rows").alias("prog_rows"),
        F.sum("p_identity_breaks").alias("identity_breaks"),
        (F.coalesce(F.sum("a_negatives"), F.lit(0))
         + F.coalesce(F.sum("p_negatives"), F.lit(0))).alias("negatives"),
        count_if(F.col("a_rows") > 1).alias("dup_act"),
        sum_if(F.col("a_rows"), has_act & beyond).alias("rows_beyond_extract"),
        count_if(has_prog & ~has_act).alias("prog_cells_without_act"),
        count_if(has_act & ~has_prog).alias("act_cells_without_prog"),
        F.sum("a_sessions_lt_actives").alias("cells_sessions_lt_actives"),
        F.sum("a_playtime_gt_24h").alias("cells_playtime_gt_24h"),
        F.sum("p_users_gt_starts").alias("cells_users_gt_starts"),
    )


def _is_bad_cohort() -> Column:
    d0 = F.col("d0")
    return (F.col("has_act") == 1) & (d0.isNull() | (d0 == 0) | (F.col("later") > d0))


def bad_cohort_cells_from_cohorts(cohorts: DataFrame) -> DataFrame:
    """Q8 detail from the cohort rollup (same rows as ``bad_cohort_cells``)."""
    return cohorts.filter(_is_bad_cohort()).select(*S.KEY5, "d0", "later")


def integrity_from_pairs(pairs: DataFrame, prog: DataFrame, extract: dt.date,
                         spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Q19 over precomputed grain pairs (see ``cell_pairs``)."""
    return integrity_from_cohorts(cohort_rollup(pairs, extract, spec), pairs, prog,
                                  extract, spec)


def integrity_from_cohorts(cohorts: DataFrame, pairs: DataFrame, prog: DataFrame,
                           extract: dt.date, spec: CohortSpec = CohortSpec(),
                           duplicates: DataFrame | None = None) -> DataFrame:
    """Q19 from the cohort rollup: build x install date -> build -> one row.

    The expected cohort days of a (build, date) are a bit mask compared with
    the bit mask of the days present, so no day list is generated or
    joined.  The duplicated-level count reads ``duplicates``, the result of
    ``duplicate_prog_keys`` (computed from the pairs when not given)."""
    h = spec.horizon
    d = _c(S.INSTALL_DATE)
    counters = COHORT_COUNTERS

    def total(c: str) -> Column:
        return F.sum(c).alias(c)

    # Build x install date.
    vd = cohorts.groupBy(S.VERSION, S.INSTALL_DATE).agg(
        *[F.bit_or(name).alias(name) for name, _ in _masks(spec)],
        F.max("has_act").alias("has_act"),
        count_if(_is_bad_cohort()).alias("bad_cohort_cells"),
        *[total(c) for c in counters],
    )
    last = F.least(F.lit(h), F.datediff(F.lit(extract), d))

    def missing_of(name: str, first: int) -> Column:
        n = F.least(last - first + 1, F.lit(DAYS_PER_MASK))
        expected = F.when(n > 0, _bit(n) - 1).otherwise(F.lit(0).cast("bigint"))
        # A NULL install date never matches an expected day (NULL = NULL is not
        # true), so none of its days count as present.
        present = F.when(d.isNull(), F.lit(0).cast("bigint")).otherwise(
            F.coalesce(F.col(name), F.lit(0).cast("bigint")))
        return F.bit_count(expected.bitwiseAND(F.bitwise_not(present)))

    absent = sum((missing_of(*m) for m in _masks(spec)), F.lit(0))
    missing = F.when(F.col(S.VERSION).isin(*spec.builds) & (F.col("has_act") == 1), absent)

    # Build.
    per_build = vd.groupBy(S.VERSION).agg(
        (F.datediff(max_if(d, F.col("has_act") == 1), F.min(F.when(F.col("has_act") == 1, d))) + 1
         - count_if(F.col("has_act") == 1)).alias("install_date_gaps"),
        F.sum(missing).alias("missing_version_day_rows"),
        total("bad_cohort_cells"),
        *[total(c) for c in counters],
    )
    names = counters + ["bad_cohort_cells", "missing_version_day_rows", "install_date_gaps"]
    one_row = per_build.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                              for c in names])
    if duplicates is None:
        duplicates = duplicate_prog_keys(prog, pairs)
    dup_prog = duplicates.agg(
        F.lit("dup_prog").alias("check_name"), F.count(F.lit(1)).alias("n"))
    return one_row.unpivot([], names, "check_name", "n").unionByName(dup_prog)
