"""Persisting report results (A5).

Each report is written as its own dataset, and the small ones are also
folded into one long table -- (report, keys, metric, value) -- the
distributed counterpart of a JSON file holding every number of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def long_metrics(name: str, report: DataFrame) -> DataFrame | None:
    """One row per numeric cell of ``report``: the other columns become a
    string map of keys.  None when the report has no numeric column."""
    fields = report.schema.fields
    values = [f.name for f in fields if isinstance(f.dataType, NUMERIC)]
    keys = [f.name for f in fields if f.name not in values]
    if not values:
        return None
    key_map = (F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))])
               if keys else F.create_map().cast("map<string,string>"))
    wide = report.select(key_map.alias("keys"),
                         *[F.col(v).cast("double").alias(v) for v in values])
    return (wide.unpivot(["keys"], values, "metric", "value")
            .select(F.lit(name).alias("report"), "keys", "metric", "value"))


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_metrics(reports: dict[str, DataFrame], path: str, mode: str = "overwrite") -> DataFrame:
    """Write the long form of all ``reports`` to ``path``; returns it."""
    parts = [p for p in (long_metrics(n, df) for n, df in reports.items()) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode(mode).parquet(path)
    return out


#: Typed value columns of ``typed_metrics``: kind -> (column, Spark type).
VALUE_COLUMNS = {"double": ("value_double", "double"), "long": ("value_long", "bigint"),
                 "date": ("value_date", "date"), "boolean": ("value_boolean", "boolean"),
                 "text": ("value_text", "string")}


def value_kind(kind: T.DataType) -> str:
    """Which typed column a report column's values go to."""
    if isinstance(kind, T.IntegralType):
        return "long"
    if isinstance(kind, T.NumericType):
        return "double"
    return {T.DateType: "date", T.BooleanType: "boolean"}.get(type(kind), "text")


def typed_metrics(name: str, report: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per value of ``report``, each in the column of its own type:
    (report, keys, metric, kind, value_*).  ``keys`` name a row of the report;
    every other column is a metric, dates, booleans and texts included, so a
    report without numbers is kept whole.  All but one of the value columns
    are NULL; a NULL value has only NULLs and still has its row."""
    missing = [k for k in keys if k not in report.columns]
    if missing:
        raise ValueError(f"{name}: no key columns {missing}")
    metrics = [f for f in report.schema.fields if f.name not in keys]
    key_map = (F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))])
               if keys else F.create_map().cast("map<string,string>"))

    def one(f: T.StructField):
        own = value_kind(f.dataType)
        return F.struct(F.lit(f.name).alias("metric"), F.lit(own).alias("kind"),
                        *[(F.col(f.name) if k == own else F.lit(None)).cast(t).alias(c)
                          for k, (c, t) in VALUE_COLUMNS.items()])
    rows = report.select(key_map.alias("keys"), F.array(*[one(f) for f in metrics]).alias("m"))
    return (rows.select("keys", F.inline("m"))
            .select(F.lit(name).alias("report"), "keys", "metric", "kind",
                    *[c for c, _ in VALUE_COLUMNS.values()]))


def keys_text(keys) -> "F.Column":
    """A key map as one text, ``name=value`` sorted by name: comparable and groupable."""
    entries = F.array_sort(F.map_entries(keys))
    return F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")
