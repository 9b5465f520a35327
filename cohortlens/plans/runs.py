"""Published runs (A5): a run's results become visible whole, or not at all.

A run writes its reports under ``root/runs/<run id>``, where nobody looks for
results.  When all are written, one row is appended to ``root/published``:
run id, time, window, and each report's path, format and columns.  That append
is the commit: Spark's committer moves its single small file into place, so
readers see the whole run or still the one before.  A run killed between two
reports, or refused by the integrity rule, leaves no row; its folder is never
read.  Runs don't overwrite each other, so earlier ones stay readable by id
and a reader that began before a commit keeps reading the run it began with.

The metrics of a published run are typed (``sources.metrics.typed_metrics``):
dates, booleans, texts, whole numbers and doubles keep their own type.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.plans.analysis import (
    DETAIL_REPORTS, AnalysisParams, metrics_table, run_analysis)
from cohortlens.spec import CohortSpec

TYPED = "typed_metrics"

PUBLISHED = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("extract_date", T.DateType()),
    T.StructField("reports", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),      # relative to the root
        T.StructField("format", T.StringType()),
        T.StructField("columns", T.StringType()),   # the schema, as JSON
    ]))),
])


class NoPublishedRun(LookupError):
    """Nothing is published under this root, or not this run or report."""


@dataclass(frozen=True)
class Run:
    run_id: str
    published_at: dt.datetime
    extract_date: dt.date | None
    reports: dict[str, tuple[str, str, str]]


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every published run, one row each (empty before the first)."""
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{root}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISHED)


def published(spark: SparkSession, root: str, run_id: str | None = None) -> Run:
    """A published run, by default the latest (the greatest time, then id)."""
    runs = published_runs(spark, root)
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    row = runs.orderBy(F.desc("published_at"), F.desc("run_id")).limit(1).collect()
    if not row:
        raise NoPublishedRun(f"{root}: no published run" + (f" {run_id}" if run_id else ""))
    (r,) = row
    return Run(r["run_id"], r["published_at"], r["extract_date"],
               {x["name"]: (x["path"], x["format"], x["columns"]) for x in r["reports"]})


def read_published(spark: SparkSession, root: str, report: str, run_id: str | None = None) -> DataFrame:
    """A report (or ``typed_metrics``) of a published run, with the schema it was written with."""
    run = published(spark, root, run_id)
    if report not in run.reports:
        raise NoPublishedRun(f"{root}: run {run.run_id} has no report {report!r}")
    path, fmt, columns = run.reports[report]
    return spark.read.schema(T.StructType.fromJson(json.loads(columns))).format(fmt).load(f"{root}/{path}")


def publish(spark: SparkSession, root: str, run_id: str, extract: dt.date | None,
            reports: dict[str, tuple[str, str]]) -> Run:
    """Commit a run: append its row to ``root/published``.  ``reports`` is name -> (path
    relative to the root, format); every one is opened first, so a run with a
    missing report is not published."""
    entries = [(name, path, fmt, spark.read.format(fmt).load(f"{root}/{path}").schema.json())
               for name, (path, fmt) in sorted(reports.items())]
    now = dt.datetime.now(dt.timezone.utc)
    row = spark.createDataFrame([(run_id, now, extract, entries)], PUBLISHED)
    row.coalesce(1).write.mode("append").parquet(f"{root}/published")
    return published(spark, root, run_id)


def published_run(spark: SparkSession, act: DataFrame, prog: DataFrame, root: str,
                  spec: CohortSpec = CohortSpec(), params: AnalysisParams = AnalysisParams(),
                  run_id: str | None = None, **options) -> Run:
    """``run_analysis`` into a folder of its own under ``root``, its typed metrics, then the commit.

    Any failure on the way, the stop-the-run rule included, raises and leaves
    what was published before as it is.  ``options`` go to ``run_analysis``."""
    run_id = run_id or uuid.uuid4().hex
    folder = f"runs/{run_id}"
    fmt = options.get("out_format", "parquet")
    if published_runs(spark, root).filter(F.col("run_id") == run_id).count():
        raise ValueError(f"run {run_id!r} is published already")
    paths = run_analysis(spark, act, prog, f"{root}/{folder}", spec, params, **options)
    paths.pop("metrics", None)
    reports = {n: spark.read.parquet(p) if fmt == "parquet" else spark.read.json(p)
               for n, p in paths.items()}
    small = {n: df for n, df in reports.items() if n not in DETAIL_REPORTS and df.columns}
    if small:
        metrics_table(small).coalesce(1).write.mode("overwrite").parquet(f"{root}/{folder}/{TYPED}")
    extract = None
    if "analysis_window" in reports:
        extract = reports["analysis_window"].select(F.col("extract_date").cast("date")).first()[0]
    listed = {n: (f"{folder}/{n}", fmt) for n in paths}
    if small:
        listed[TYPED] = (f"{folder}/{TYPED}", "parquet")
    return publish(spark, root, run_id, extract, listed)


def metric_history(spark: SparkSession, root: str, report: str, metric: str) -> DataFrame:
    """One metric over all published runs: (run_id, published_at, extract_date, keys, kind, value_*)."""
    runs = published_runs(spark, root).collect()   # one small row a run
    parts = [
        read_published(spark, root, TYPED, r["run_id"])
        .filter((F.col("report") == report) & (F.col("metric") == metric)).drop("report", "metric")
        .select(F.lit(r["run_id"]).alias("run_id"), F.lit(r["published_at"]).alias("published_at"),
                F.lit(r["extract_date"]).alias("extract_date"), "*")
        for r in runs if any(x["name"] == TYPED for x in r["reports"])]
    if not parts:
        raise NoPublishedRun(f"{root}: no published run with metrics")
    return reduce(DataFrame.unionByName, parts)
