"""Nightly re-runs over growing cells: only new and changed install dates are read.

Cells are stored a directory per install date (``sources.cells.write_cells``).
Everything the reports read -- the two cubes and the grain pairs -- has the
install date in its key, so a date's part of them depends on that date's cells
alone and parts of different dates just stand side by side.  The state under
``root`` keeps these parts:

    state/<table>/version=<v>/   the parts computed by one refresh
    state/committed              a row per refresh: which version holds each
                                 date, and the signature of the files it was
                                 computed from

A refresh lists the cell files (names, sizes and times, not their content),
compares each date's signature with the committed one and reads the cells of
new and changed dates only, through partition filters.  The one row appended
to ``state/committed`` makes the new parts count; a refresh killed before it
leaves the state as it was, and what it wrote is never read.  Late cells change
their date's files and so its signature; dates whose files are gone are left
out; another spec starts afresh.

Reading joins a table's parts to the committed dates (a row per install date,
broadcast) on version and date, so superseded parts are skipped.  ``compacted``
rewrites a state as one version when many have gathered.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import spec as S
from cohortlens.operators import integrity as Q
from cohortlens.operators.window import derive_window
from cohortlens.plans import analysis as A
from cohortlens.plans.runs import Run, published_run
from cohortlens.session import shared_dir
from cohortlens.sources.cells import read_activity, read_progression
from cohortlens.spec import CohortSpec

TABLES = ("act_cube", "prog_cube", "cell_pairs")

COMMITTED = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("spec", T.StringType()),
    T.StructField("dates", T.ArrayType(T.StructType([
        T.StructField("day", T.DateType()),          # NULL: cells without an install date
        T.StructField("signature", T.StringType()),
        T.StructField("version", T.StringType()),
    ]))),
])

Dates = dict[dt.date | None, tuple[str, str]]   # day -> (signature, version)


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: its version (None if nothing changed), the dates it read and all dates."""
    version: str | None
    read: tuple[dt.date | None, ...]
    dates: Dates


def date_signatures(spark: SparkSession, paths: tuple[str, ...]) -> dict[dt.date | None, str]:
    """Per install date, a digest of its files' names, sizes and times over all ``paths``."""
    parts = []
    for k, path in enumerate(paths):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "*.parquet").load(path))
        parts.append(files.select(
            F.regexp_extract("path", f"/{S.INSTALL_DATE}=([^/]*)/", 1).alias("day"),
            F.concat_ws("|", F.lit(k), "path", "length", F.unix_micros("modificationTime")).alias("file")))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    # Digests of files added up: no list of a date's files is gathered anywhere.
    digests = [F.sum(F.xxhash64("file", F.lit(k)) % (1 << 40)).cast("string") for k in range(3)]
    rows = files.groupBy("day").agg(F.concat_ws("-", F.count(F.lit(1)), *digests).alias("signature")).collect()
    if any(r["day"] == "" for r in rows):
        raise ValueError(f"cells are not stored by {S.INSTALL_DATE}: {paths}")
    day = lambda text: None if text.startswith("__HIVE") else dt.date.fromisoformat(text)
    return {day(r["day"]): r["signature"] for r in rows}


def _fingerprint(spec: CohortSpec) -> str:
    return f"dims={spec.dims} level_dims={A.LEVEL_DIMS}"   # what the state's tables depend on


def committed(spark: SparkSession, state: str, spec: CohortSpec) -> Dates:
    """The dates that the state holds for this spec, by its latest commit."""
    try:
        rows = spark.read.schema(COMMITTED).parquet(f"{state}/committed")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    last = rows.orderBy(F.desc("committed_at"), F.desc("version")).limit(1).collect()
    if not last or last[0]["spec"] != _fingerprint(spec):
        return {}
    return {d["day"]: (d["signature"], d["version"]) for d in last[0]["dates"]}


def _commit(spark: SparkSession, state: str, version: str, spec: CohortSpec, dates: Dates) -> None:
    now = dt.datetime.now(dt.timezone.utc)
    held = [(day, s, v) for day, (s, v) in dates.items()]
    row = spark.createDataFrame([(version, now, _fingerprint(spec), held)], COMMITTED)
    row.coalesce(1).write.mode("append").parquet(f"{state}/committed")


def _on_dates(cells: DataFrame, days) -> DataFrame:
    """The cells of some install dates: a partition filter."""
    known = [d for d in days if d is not None]
    keep = F.col(S.INSTALL_DATE).isin(known) if known else F.lit(False)
    return cells.filter(keep | F.col(S.INSTALL_DATE).isNull() if None in days else keep)


def _cells(spark: SparkSession, act_path: str, prog_path: str) -> tuple[DataFrame, DataFrame]:
    return read_activity(spark, act_path), read_progression(spark, prog_path)


def refresh(spark: SparkSession, act_path: str, prog_path: str, state: str,
            spec: CohortSpec = CohortSpec()) -> Refresh:
    """Bring the state up to the cells' files, reading new and changed dates only."""
    now = date_signatures(spark, (act_path, prog_path))
    held = committed(spark, state, spec)
    changed = [day for day, signature in now.items() if held.get(day, ("", ""))[0] != signature]
    kept = {day: held[day] for day in now if day not in changed}
    if not changed and kept == held:
        return Refresh(None, (), held)
    version = uuid.uuid4().hex
    if changed:
        act, prog = (_on_dates(df, changed) for df in _cells(spark, act_path, prog_path))
        parts = {"act_cube": A.activity_cube(act, spec), "prog_cube": A.progression_cube(prog),
                 "cell_pairs": Q.cell_pairs(act, prog)}
        for name, part in parts.items():
            spark.sparkContext.setJobDescription(f"cohortlens refresh {name}")
            part.write.parquet(f"{state}/{name}/version={version}")
    dates = kept | {day: (now[day], version) for day in changed}
    _commit(spark, state, version, spec, dates)
    order = sorted(changed, key=lambda d: (d is not None, d))
    return Refresh(version, tuple(order), dates)


def state_table(spark: SparkSession, state: str, name: str, dates: Dates) -> DataFrame:
    """A table of the state: of each date, the part that counts."""
    held = [(day, v) for day, (_, v) in dates.items()]
    live = spark.createDataFrame(held, "day date, held_by string")   # a row per install date
    versions = sorted({v for _, v in held})
    path = f"{state}/{name}"
    parts = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in versions])
    same = (F.col("version") == F.col("held_by")) & F.col(S.INSTALL_DATE).eqNullSafe(F.col("day"))
    return parts.join(F.broadcast(live), same, "left_semi").drop("version")


def refreshed_analysis(spark: SparkSession, act_path: str, prog_path: str, state: str,
                       spec: CohortSpec = CohortSpec(),
                       params: A.AnalysisParams = A.AnalysisParams(),
                       expected_extract: dt.date | None = None) -> tuple[A.Analysis, Refresh]:
    """An analysis over the refreshed state; the window comes from it, too, not from the cells."""
    done = refresh(spark, act_path, prog_path, state, spec)
    act, prog = _cells(spark, act_path, prog_path)
    act_cube, prog_cube, pairs = (state_table(spark, state, name, done.dates) for name in TABLES)
    act_day, prog_level = (A._cached(A.cube_part(c, A.ALL_CELLS)) for c in (act_cube, prog_cube))
    window = derive_window(act_day, spec, expected_extract)
    work = f"{shared_dir(spark)}/cohortlens-run/{uuid.uuid4().hex}"
    return A.Analysis(spark, act, prog, window, act_day, prog_level, pairs, spec, params,
                      work_dir=work, act_cube=act_cube, prog_cube=prog_cube), done


def nightly_run(spark: SparkSession, act_path: str, prog_path: str, root: str,
                spec: CohortSpec = CohortSpec(), params: A.AnalysisParams = A.AnalysisParams(),
                run_id: str | None = None, expected_extract: dt.date | None = None,
                **options) -> tuple[Run, Refresh]:
    """Refresh the state under ``root/state``, run every report on it, publish the run."""
    analysis, done = refreshed_analysis(spark, act_path, prog_path, f"{root}/state", spec, params,
                                        expected_extract)
    run = published_run(spark, analysis.act, analysis.prog, root, spec, params, run_id,
                        analysis=analysis, **options)
    return run, done


def compacted(spark: SparkSession, state: str, spec: CohortSpec = CohortSpec()) -> str | None:
    """Rewrite the state as one version and commit it; what is held does not change.  The
    earlier versions' folders are free to go once no reader uses them."""
    dates = committed(spark, state, spec)
    if len({v for _, v in dates.values()}) < 2:
        return None
    version = uuid.uuid4().hex
    for name in TABLES:
        state_table(spark, state, name, dates).write.parquet(f"{state}/{name}/version={version}")
    _commit(spark, state, version, spec, {day: (s, version) for day, (s, _) in dates.items()})
    return version
