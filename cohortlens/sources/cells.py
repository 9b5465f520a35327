"""Reading and writing the cohort-cell tables (A1-A4).

CSV is read by the names in its header.  Write it once as Parquet partitioned
by install date (``write_cells``), and the window filter of every report
becomes partition pruning plus row-group pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import spec as S


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        # Columns go by the header's names: their order is free, further ones are ignored.
        options = {"header": True, "mode": "FAILFAST", "dateFormat": "yyyy-MM-dd"}
        header = spark.read.options(**options).csv(path).columns
        missing = [f.name for f in schema.fields if f.name not in header]
        if missing:
            raise ValueError(f"{path}: columns missing: {missing}")
        of = {f.name: f.dataType for f in schema.fields}
        as_written = T.StructType([T.StructField(c, of.get(c, T.StringType())) for c in header])
        df = spark.read.schema(as_written).options(**options, enforceSchema=False).csv(path)
        return df.select(*[f.name for f in schema.fields])
    if fmt == "parquet":
        df = spark.read.parquet(path)
        # Parquet keeps its own types; align them to the declared schema
        # (a timestamp install date becomes a date, ints become bigint).
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    raise ValueError(f"unsupported format {fmt!r}")


def read_activity(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Activity cells (A1).  ``fmt`` is 'csv' (header row) or 'parquet'."""
    return _read(spark, path, S.ACTIVITY_SCHEMA, fmt)


def read_progression(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Progression cells (A2)."""
    return _read(spark, path, S.PROGRESSION_SCHEMA, fmt)


#: Why a record is quarantined.
MALFORMED, NO_KEY = "malformed", "missing key"
_RECORD = "_record"


def _read_checked(spark: SparkSession, path: str, schema: T.StructType,
                  keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, quarantine) of CSV files: one bad record doesn't stop the run.

    Malformed records (a value that isn't of its column's type, a wrong number
    of fields) and records without a part of their key go to the quarantine,
    with the file, the text of a malformed record, the reason, and whatever of
    their columns could be read.  The cells are the rest.  Both are filters of
    one lazy scan.  The reader converts, and so checks, only the columns that
    are asked for; the reason depends on all of the file's, so a record is bad
    for every report or for none."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path}: columns missing: {missing}")
    of = {f.name: f.dataType for f in schema.fields}
    fields = [T.StructField(c, of.get(c, T.StringType())) for c in header]
    df = (spark.read.schema(T.StructType([*fields, T.StructField(_RECORD, T.StringType())]))
          .options(header=True, mode="PERMISSIVE", dateFormat="yyyy-MM-dd", enforceSchema=False,
                   columnNameOfCorruptRecord=_RECORD).csv(path))
    names = [f.name for f in schema.fields]
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in header), F.lit(0))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    reason = F.when(F.col(_RECORD).isNotNull() & (nulls >= 0), MALFORMED).when(no_key, NO_KEY)
    marked = df.select(*names, F.col(_RECORD).alias("record"), reason.alias("reason"),
                       F.col("_metadata.file_path").alias("file"))
    cells = marked.filter(F.col("reason").isNull()).select(*names)
    return cells, marked.filter(F.col("reason").isNotNull())


def read_activity_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Activity cells of CSV files, and the records that are none (A1)."""
    return _read_checked(spark, path, S.ACTIVITY_SCHEMA, S.KEY6)


def read_progression_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Progression cells of CSV files, and the records that are none (A2)."""
    return _read_checked(spark, path, S.PROGRESSION_SCHEMA, S.KEY7)


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    """Quarantined records by reason, as rows of the integrity report: check_name, n (0 for none)."""
    counts = quarantine.agg(*[F.count(F.when(F.col("reason") == r, 1)).alias(f"{r.replace(' ', '_')}_records")
                              for r in (MALFORMED, NO_KEY)])
    return counts.unpivot([], counts.columns, "check_name", "n")


def register(spark: SparkSession, act: DataFrame, prog: DataFrame,
             names: tuple[str, str] = ("act", "prog")) -> None:
    """Name the two relations for SQL users (A3)."""
    act.createOrReplaceTempView(names[0])
    prog.createOrReplaceTempView(names[1])


def write_cells(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: str | None = S.INSTALL_DATE) -> None:
    """Persist cells as Parquet, one directory per install date (A4).

    ``rebalance`` lets AQE split a date that holds a large share of the rows
    into several files and merge small dates, instead of one task per date.

    Mode 'dates' replaces the dates that ``df`` holds and leaves the files of
    all others as they are: for late cohort days, ``df`` being all cells of the
    dates they belong to.  Writing the same cells again gives the same table.
    """
    if mode == "dates":
        if not partition_by:
            raise ValueError("mode 'dates' needs cells partitioned by date")
        (df.hint("rebalance", partition_by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path))
    elif partition_by:
        (df.hint("rebalance", partition_by)
         .write.mode(mode).partitionBy(partition_by).parquet(path))
    else:
        df.write.mode(mode).parquet(path)
