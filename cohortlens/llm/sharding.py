"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

``row_numbers`` gives every row of a table a gapless global number that depends on
the rows' contents only, ``place`` permutes the numbers 0 .. n-1, and a row's
shard and slot are its place modulo and divided by the number of shards: law
``rows``, shard sizes are at most one apart.  Neither a shuffle of the data nor a
random sort decides where a row goes: ``place`` is computed from its number
alone, and ``row_at`` leads back from a shard and slot to the row's number, so a
reader can find a shard's rows, or resume within a shard, by arithmetic.

The permutation: a number is split into (l, r) = (x mod a, x div a) with
a = ceil(sqrt(n)) and b = ceil(n / a); each round adds a keyed hash of one half to
the other half, modulo a or b in turn.  That permutes 0 .. a*b-1, fewer than a
numbers of which are n or more; a result there is put through the permutation
again (cycle walking) until it is below n.  ``walk_steps`` counts how long the
longest walk is, by following all walks through those fewer than a numbers, so
the fixed number of steps in ``place`` is proved for each n, not assumed.

Row numbers: rows are ordered by a hash of the ``by`` columns.  A group of rows
that agree in all of them is counted by where its rows were read, so a group that
holds a third of all rows is dealt out over as many tasks as hold it; hash ranges
are numbered from their running totals (``BUCKETS`` rows).  Functions of DataFrames
only; whole texts are never moved.

Defined cases: null texts have size 16 and the checksum of the empty text; null
ids are one value of their own; rows that agree in id, size and checksum take
consecutive numbers in the order they are read, which no column of the result tells
apart; copies (equal texts) with different ids are rows like any others and spread
over the shards; an empty table gives no rows; fewer rows than shards leave the
last shards empty; extra columns are carried by ``row_numbers`` and ``sharded``,
whose own columns (``row``, ``place``, ``shard``, ``slot``) replace carried ones.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import written

SHARDS = 40
ROUNDS = 6
SEED = 42
BUCKETS = 4096  # three hexadecimal digits of the key
OVERHEAD = 16  # bytes a row takes besides its text


def halves(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _hash(seed: int, k: Column, v: Column, modulus: int) -> Column:
    """48 bits of a keyed hash, modulo ``modulus``."""
    text = F.concat_ws(":", F.lit(str(seed)), k.cast("string"), v.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(modulus))


def permuted(x: Column, n: int, seed: int = SEED, back: bool = False) -> Column:
    """One pass of the Feistel network over 0 .. a*b-1 (``back``: of its inverse)."""
    a, b = halves(n)
    sign = F.lit(-1 if back else 1)

    def one(x: Column, k: Column) -> Column:
        left, right = F.pmod(x, F.lit(a)), F.call_function("div", x, F.lit(a))
        even = F.pmod(left + sign * _hash(seed, k, right, a), F.lit(a)) + F.lit(a) * right
        odd = left + F.lit(a) * F.pmod(right + sign * _hash(seed, k, left, b), F.lit(b))
        return F.when(k % 2 == 0, even).otherwise(odd)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, x.cast("long"), one)


def walk_steps(spark: SparkSession, n: int, seed: int = SEED) -> int:
    """Passes beyond the first that the longest walk from a number below ``n`` takes.

    Only walks through the fewer than sqrt(n) + 1 numbers from n on need any: they start where the
    inverse leads below n, and are followed together, a round at a time, until all have ended."""
    a, b = halves(n)
    if a * b <= n:
        return 0
    outside = spark.range(n, a * b).select(F.col("id").alias("x"))
    frontier = outside.where(permuted(F.col("x"), n, seed, back=True) < n)
    steps = 0
    while left := [r.x for r in frontier.collect()]:  # a few numbers: all fewer than sqrt(n), most walks end at once
        steps += 1
        frontier = spark.createDataFrame([(x,) for x in left], "x long").select(permuted(F.col("x"), n, seed).alias("x")).where(F.col("x") >= n)
    return steps


def place(row: Column, n: int, steps: int, seed: int = SEED, back: bool = False) -> Column:
    """The place of a row number after the shuffle (``back``: the row number at a place)."""
    walk = lambda x, _: F.when(x >= n, permuted(x, n, seed, back)).otherwise(x)
    first = permuted(row, n, seed, back)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, walk) if steps else first


def row_at(shard: Column, slot: Column, n: int, steps: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The row number that the shuffle puts into ``slot`` of ``shard``."""
    return place(slot * F.lit(shards) + shard, n, steps, seed, back=True)


def content_key(by: list[str]) -> Column:
    """Hexadecimal hash of the columns' values, nulls told from empty strings."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by] + [F.col(c).isNull().cast("int").cast("string") for c in by]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def row_numbers(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """``df`` with a gapless number ``row`` from 0 in the order of ``content_key(by)``, and the number of rows.

    ``df`` is written once; the places its rows are read from then tell equal rows apart."""
    carried = [c for c in df.columns if c not in ("row", "rn_key")]
    src = written(df.select(*carried, content_key(by).alias("rn_key")), "rows")
    src = src.withColumns({"rn_part": F.spark_partition_id(), "rn_at": F.monotonically_increasing_id()})
    bucket = F.substring("rn_key", 1, 3)
    counts = src.groupBy("rn_key", "rn_part").agg(F.count(F.lit(1)).alias("rn_count"))
    before = Window.partitionBy(bucket).orderBy("rn_key", "rn_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("rn_start", F.coalesce(F.sum("rn_count").over(before), F.lit(0))), "starts")
    totals = starts.groupBy(bucket.alias("rn_bucket")).agg(F.sum("rn_count").alias("rn_total"))  # BUCKETS rows at most
    sums = F.sum("rn_total").over(Window.orderBy("rn_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("rn_bucket", F.coalesce(sums, F.lit(0)).alias("rn_offset"))
    n = totals.agg(F.coalesce(F.sum("rn_total"), F.lit(0))).first()[0]
    starts = starts.join(F.broadcast(offsets), bucket == F.col("rn_bucket")).select("rn_key", "rn_part", (F.col("rn_start") + F.col("rn_offset")).alias("rn_first"))
    within = F.row_number().over(Window.partitionBy("rn_key", "rn_part").orderBy("rn_at")) - 1
    numbered = src.join(starts, ["rn_key", "rn_part"]).withColumn("row", (F.col("rn_first") + within).cast("long"))
    return numbered.select(*carried, "row"), int(n)


def sharded(df: DataFrame, by: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``row`` (global number), ``place`` after the shuffle, ``shard`` and ``slot``."""
    numbered, n = row_numbers(df.drop("place", "shard", "slot"), by)
    steps = walk_steps(df.sparkSession, n, seed)
    at = numbered.withColumn("place", place(F.col("row"), n, steps, seed))
    return at.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.call_function("div", F.col("place"), F.lit(shards))})


def document_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digests = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharded(digests, ["doc_id", "size", "text_crc32"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
