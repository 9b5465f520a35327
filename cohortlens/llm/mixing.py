"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size.  Each source's target is its
share by weight of ``share`` times all sizes; no target exceeds ``cap`` times the
source's size, and what is cut off is shared again by weight.  A source whose
target reaches its size is taken whole first; for the remaining budget every
size's count is taken in proportion, and bounded-knapsack dynamic programming
over sizes and left-over counts fits the rest to the largest sum that they reach below
it.  So a source whose target is under its size takes each document at most once, and
one of a few documents may stay further from its target.  Where rounding down leaves
more than ``DP_BUDGET`` words, largest documents go first until the rest is below that.
The chosen number of documents of each size is then drawn by a seeded hash of
the document id.

Planning works on counts, never on documents: at most one row per source, size
and hash bucket.  A size that a third of all rows share is spread over
``BUCKETS`` buckets, and ranks are taken within a bucket.

Defined cases: null and empty texts have size 0 and add nothing; the null
source is a source, last in order; a source without words has target 0; an
empty table gives an empty mix; rows with one id and size are interchangeable,
each counts for itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BUCKETS = 4096
DP_BUDGET = 1 << 16


def words_of(text: Column) -> Column:
    """Number of words between white space (0x20, 0x09-0x0D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take (0..count) so that their sum comes closest below ``budget``."""
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((take * sizes).sum())
    if rest < 0:  # rounding of very large products
        take[:] = 0
        rest = budget
    for j in np.argsort(-sizes, kind="stable"):  # down to a budget that the dynamic programme can hold
        if rest <= DP_BUDGET:
            break
        k = min(int(counts[j] - take[j]), rest // max(int(sizes[j]), 1)) if sizes[j] else 0
        take[j] += k
        rest -= k * int(sizes[j])
    return take + knapsack(sizes, counts - take, min(rest, DP_BUDGET))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts per size whose sum is the largest reachable one up to ``budget``."""
    chosen = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return chosen
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by_item = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int, int]] = []  # size index, copies, weight; copies in powers of two
    for j in np.argsort(-sizes, kind="stable"):
        size, left, copies = int(sizes[j]), int(counts[j]), 1
        if size <= 0 or size > budget:
            continue
        left = min(left, budget // size)
        while left > 0 and not reached[budget]:
            copies = min(copies, left)
            weight = copies * size
            new = np.zeros_like(reached)
            new[weight:] = reached[: budget + 1 - weight]
            new &= ~reached
            by_item[new] = len(items)
            reached |= new
            items.append((int(j), copies, weight))
            left -= copies
            copies *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        j, copies, weight = items[by_item[at]]
        chosen[j] += copies
        at -= weight
    return chosen


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("mx_size")
    sizes, counts = pdf.mx_size.to_numpy(np.int64), pdf.n.to_numpy(np.int64)
    total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    whole = min(CAP, int(target // total)) if total else 0
    extra = fit_budget(sizes, counts, round(target - whole * total)) if whole < CAP else np.zeros(len(sizes), np.int64)
    return pd.DataFrame({"mx_key": pdf.mx_key, "mx_size": sizes, "whole": whole, "extra": extra, "source_size": total, "target": target})


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(mx_key, source_size, target) from (mx_key, source_size), one row per source.

    Equal to sharing by weight, cutting at the cap and sharing the excess again until none is above."""
    rank = F.row_number().over(Window.orderBy(F.col("mx_key") == "n", "mx_key"))  # one row per source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(sources.withColumn("w", weight).withColumn("full", F.lit(cap) * F.col("source_size")), "mixing-sources")
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("full") <= F.col("w") * F.lit(level)
        r = rows.agg(
            F.sum(F.lit(share) * F.col("source_size")).alias("all"),
            F.sum(F.when(capped, F.col("full")).otherwise(0.0)).alias("cut"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("w"),
        ).first()
        new = (r["all"] - r["cut"]) / r["w"] if r["w"] else level
        if level is not None and (new is None or new <= level):
            break
        level = new
        if level is None:
            break
    target = F.least(F.col("full").cast("double"), F.col("w") * F.lit(level if level is not None else 0.0))
    return rows.select("mx_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` with mx_size, source_size, target and copies (0 to 2) of every document."""
    own = {"mx_key", "mx_size", "mx_bucket", "mx_draw", "mx_id", "mx_rank", "whole", "left", "copies", "source_size", "target"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in own]  # equally named columns are replaced
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    drawn = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(
        *(F.col(f"`{c}`") for c in carry), key.alias("mx_key"), words_of(F.col(text_col)).alias("mx_size"), drawn.alias("mx_draw"),
        F.pmod(drawn, F.lit(BUCKETS)).alias("mx_bucket"), F.col(id_col).alias("mx_id"),
    )
    keys = ["mx_key", "mx_size", "mx_bucket"]
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "mixing-counts")
    by_size = counts.groupBy("mx_key", "mx_size").agg(F.sum("n").alias("n"))
    targets = source_targets(by_size.groupBy("mx_key").agg(F.sum(F.col("mx_size") * F.col("n")).alias("source_size")))
    plan = (
        by_size.join(targets, "mx_key")
        .groupBy("mx_key")
        .applyInPandas(_fit_source, "mx_key string, mx_size long, whole long, extra long, source_size long, target double")
    )
    before = F.sum("n").over(Window.partitionBy("mx_key", "mx_size").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = (
        counts.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(plan, ["mx_key", "mx_size"])
        .select(*keys, "whole", (F.col("extra") - F.col("before")).alias("left"), "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("mx_draw", "mx_id"))
    copies = F.col("whole") + (F.col("mx_rank") <= F.col("left")).cast("long")
    got = rows.withColumn("mx_rank", rank).join(quota, keys).withColumn("copies", copies)
    return got.drop("mx_rank", "mx_draw", "mx_bucket", "mx_id", "mx_key", "whole", "left")


def document_mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes)."""
    rows = mix(docs, carry=["doc_id"])
    return rows.select("doc_id", F.col("mx_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mx_size")).alias("taken"))
