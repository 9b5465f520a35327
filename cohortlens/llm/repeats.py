"""Removal of repeated byte strings: sparse suffixes refined level by level across shards.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else.  A merge of whole Burrows-Wheeler transforms needs one round over every
suffix for each byte of common prefix (400 here).  This operator keeps that
scheme's core, refining groups of suffixes by ever longer common prefixes
across all shards without sorting suffixes anew, but over a sparse set of
suffixes and with two levels in place of 400 rounds:

* Anchors are the positions of the least 16-byte hash in any ``WINDOW``
  neighbouring positions.  They depend on nearby bytes only, so equal strings
  have equal anchors; every start of a ``length``-byte string belongs to the
  first anchor at or after it, and the anchor's next ``CORE`` bytes lie in it.
* Level 1: suffixes at anchors are grouped by their ``CORE`` bytes.  Groups of one
  leave: no string that starts before them is repeated.
* Level 2: what is left is grouped by all bytes that the strings of an anchor
  span.  In a group of two or more all those strings are repeated; a core with
  one such group only is settled.
* Where a core has several groups, one member of each sends a hash per start,
  and starts are repeated where hashes meet.

Only hashes and positions are shuffled, except for texts of documents that
take part in the last step or lose bytes.

Defined cases: null and empty texts, and texts under ``length`` bytes, lose
nothing and never match; strings do not cross documents; overlapping
occurrences in one document count; equal rows repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.bloom import bit_table, member
from cohortlens.llm.shared import bounded_batches, written

LENGTH = 400
WINDOW = 128
GRAM = 16
CORE = LENGTH - WINDOW + 1
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


class Anchors:
    """Anchors of a run's rows: position, range of starts (lo..hi), row; positions within the run."""

    def __init__(self, run: X.Run, length: int = LENGTH):
        raw, off = run.raw, run.off
        self.length, self.pre = length, X.prefix_hash(raw)
        _, self.down = X.powers(len(raw) + 1)
        steps = np.zeros(len(raw) + 1, np.int32)
        a, b = off[:-1], off[1:] - length + 1
        np.add.at(steps, a[b > a], 1)
        np.add.at(steps, b[b > a], -1)
        start = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        self.pos = self.lo = self.hi = self.row = np.zeros(0, np.int64)
        if not len(start):
            return
        i = np.arange(len(raw) - GRAM + 1)
        least = (X.mix((self.pre[i + GRAM] - self.pre[i]) * self.down[i]) & ~_LOW) | (_LOW - i.astype(_U))
        width = 1
        while width < WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        at = (_LOW - (least[start] & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(start) != 1)])
        self.pos, self.lo, self.hi = at[first], start[first], start[np.r_[first[1:], len(start)] - 1]
        self.row = np.searchsorted(off, self.lo, side="right") - 1

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return X.mix((self.pre[b] - self.pre[a]) * self.down[a] + (b - a).astype(_U))

    def core(self) -> np.ndarray:
        return self.hash(self.pos, self.pos + self.length - WINDOW + 1)

    def span(self) -> np.ndarray:
        """Hash of all bytes the anchor's strings span, and of where the anchor lies in them."""
        place = ((self.pos - self.lo) * 4096 + (self.hi - self.lo)).astype(_U)
        return X.mix(self.hash(self.lo, self.hi + self.length) + place)


def _core_counts(rows: DataFrame, length: int) -> DataFrame:
    """Cores that occur more than once."""

    def count(batches):
        for batch in batches:
            for run in X.chunks(batch.column(0)):
                value, n = np.unique(Anchors(run, length).core(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["core", "n"])

    return rows.select("text").mapInArrow(count, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")


def _flagged(rows: DataFrame, cores: DataFrame, length: int) -> DataFrame:
    """(core, span, rid, pos, lo, hi) of the anchors with a repeated core."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(cores))

    def flag(batches):
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            for run in X.chunks(batch.column(1)):
                a = Anchors(run, length)
                core = a.core().view(np.int64)
                ok = member(shared.value, core)
                base = run.off[a.row[ok]]
                cols = [core[ok], a.span().view(np.int64)[ok], rid[run.lo + a.row[ok]], a.pos[ok] - base, a.lo[ok] - base, a.hi[ok] - base]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["core", "span", "rid", "pos", "lo", "hi"])

    found = rows.select("rid", "text").mapInArrow(flag, "core long, span long, rid long, pos long, lo long, hi long")
    return found.join(cores, "core", "left_semi")


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, text) of rows whose rid is in ``ids`` (and the few that the bit table can't tell from them)."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(ids))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(member(shared.value, batch.column(0).to_numpy(zero_copy_only=False)), pa.bool_()))

    return rows.select("rid", "text").mapInArrow(some, "rid long, text string")


def _starts(rows: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """(rid, lo, hi) of the repeated starts of single members of mixed cores.

    ``members``: one row per core and span, with the number ``n`` of its occurrences."""
    per_row = members.groupBy("rid").agg(F.collect_list(F.struct("core", "pos", "lo", "hi", "n")).alias("m"))  # at most one per anchor of a text
    met = _texts(rows, members.select("rid")).dropDuplicates(["rid"]).join(per_row, "rid")

    def hashes(batches):
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            for run in X.chunks(batch.column(1)):
                pre, (_, down) = X.prefix_hash(run.raw), X.powers(len(run.raw) + 1)
                key, n, rid, start = [], [], [], []
                for row in range(run.hi - run.lo):
                    for m in lists[run.lo + row].as_py():
                        s = np.arange(m["lo"], m["hi"] + 1)
                        at = s + run.off[row]
                        h = X.mix((pre[at + length] - pre[at]) * down[at])
                        key.append(X.mix(h + np.array([m["core"]], np.int64).view(_U) * _U(3) + (m["pos"] - s).astype(_U)).view(np.int64))
                        n.append(np.full(len(s), m["n"]))
                        rid.append(np.full(len(s), rids[run.lo + row]))
                        start.append(s)
                if key:
                    cols = [np.concatenate(x) for x in (key, n, rid, start)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "n", "rid", "start"])

    each = written(met.mapInArrow(hashes, "key long, n long, rid long, start long"), "repeats-starts")
    met_again = each.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    return each.where("n = 1").join(met_again, "key", "left_semi").select("rid", F.col("start").alias("lo"), F.col("start").alias("hi"))


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, lo, hi): ranges of starts of repeated strings in ``rows`` (rid, text); equal rows share a rid."""
    cores = written(_core_counts(rows, length), "repeats-cores")
    flagged = written(_flagged(rows, cores, length), "repeats-anchors")
    first = F.min(F.struct("rid", "pos", "lo", "hi"))
    spans = written(flagged.groupBy("core", "span").agg(F.count("*").alias("n"), first.alias("f")), "repeats-spans")
    whole = flagged.join(spans.where("n > 1").select("core", "span"), ["core", "span"], "left_semi").select("rid", "lo", "hi")
    mixed = spans.groupBy("core").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("core")
    members = written(spans.join(mixed, "core", "left_semi").select("core", "n", "f.*"), "repeats-members")
    return whole.distinct().unionByName(_starts(rows, members, length))


def covered(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Merged byte spans covered by strings that start in the ranges; touching spans are one run."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is binary and null where nothing goes."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    ranges = written(repeated_starts(rows, length), "repeats-ranges")
    per_row = ranges.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # at most one per byte of a text
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(ranges.select("rid")))

    def settle(batches):  # texts that lose nothing are done here and are not shuffled
        for batch in batches:
            rid, doc_id, text = batch.column(0), batch.column(1), batch.column(2)
            open_ = pa.array(member(shared.value, rid.to_numpy(zero_copy_only=False)), pa.bool_())
            size, digest = [], []
            for value, keep in zip(text, open_.to_pylist(), strict=True):
                raw = value.as_buffer()
                size.append(raw.size)
                digest.append(None if keep else hashlib.sha256(raw).hexdigest())
            sent = pa.array([v.as_py() if keep else None for v, keep in zip(text, open_.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([rid, doc_id, sent, pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=["rid", "doc_id", "text", "n_bytes", "sha"])

    kind = docs.schema[id_col].dataType.simpleString()
    sent = rows.select("rid", "doc_id", "text").mapInArrow(settle, f"rid long, doc_id {kind}, text string, n_bytes long, sha string")

    def cut(batches):
        for batch in batches:
            removed, spans, digest, kept = [], [], [], []
            for text, sha, lists in zip(batch.column(1), batch.column(3), batch.column(4), strict=True):
                gone = covered(lists.as_py() or [], length)
                raw = text.as_buffer() if gone or not sha.is_valid else None
                left = None
                if gone:
                    view, edges = memoryview(raw), [0, *(x for span in gone for x in span), raw.size]
                    left = b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(sum(b - a for a, b in gone))
                spans.append(len(gone))
                digest.append(sha.as_py() or hashlib.sha256(left if gone else raw).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = sent.join(per_row, "rid", "left").select("doc_id", "text", "n_bytes", "sha", "ranges")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
