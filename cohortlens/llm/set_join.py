"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct word shingles.  Two sets link when
100 * intersection >= THRESHOLD * union.

* Equal sets are one class, and only its representative takes part, so copies
  are never compared.
* Shingles have one global order (very frequent ones last).  Similar sets share
  a shingle among the first ones of both, so only prefixes are indexed.
* Index-level skipping: a list is sorted by set size; an entry is compared only
  with the block of sizes that can reach the threshold, and a pair whose
  positions leave too few shingles is skipped.
* A pair is found in the list of its first common shingle.  Entries carry minima
  of their set's earlier shingles; where those of two entries are equal, both sets
  hold that shingle, so a later list skips the pair.
* Answer-level skipping: every set first takes a pivot, the most central set
  among those with an equal min-hash, and is verified against it.  Sets linked
  to one pivot have their answer already, so pairs among them are skipped in
  every list; only pairs from different pivots become candidates.
* Candidates pass exact upper bounds from counts per hash bucket, coarse ones and
  then finer ones.  Each set's likeliest candidate is verified by whole sets;
  of the other pairs, those whose answer follows (their sets are connected
  already) are skipped, and the rest is verified.

Lists of very frequent shingles are split into parts that are compared pair by
pair in separate tasks.  The order, the pivots and the filters only decide what
is compared, never the result: the links found connect exactly what all links
connect.

Defined cases: null and empty texts and texts without words have an empty set
that links with nothing; with fewer words than a shingle the whole sequence is
the one element; rows with one id are one node; null ids are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.bloom import bit_table, member
from cohortlens.llm.components import components
from cohortlens.llm.shared import bounded_batches, written

SHINGLE = 5
#: Jaccard threshold as numerator and denominator: 0.8.
NUM, DEN = 4, 5
#: Least number of counts in a coarse sketch.
SKETCH = 64
MINHASHES = 8
#: At most so many shingles are ordered last; the bound of that broadcast.
FREQUENT = 100_000
COUNTED_AT_ONCE = 1_000_000
BUCKET_ENTRIES = 400_000
SPLIT = 20_000
#: Minima kept of the shingles before an entry's own.
SEEN = 3
_U = np.uint64
#: Shingles are 47-bit hashes: only collisions within one pair of sets could matter.
_BITS = 47
_TOP = _U(1 << _BITS)


def shingle_sets(run: X.Run, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a run."""
    w = X.words(run, X.NON_SPACE)
    grams = X.combine(w.hash, shingle) >> _U(64 - _BITS)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(X.combine(w.hash[a:b] + _U(b - a), b - a) >> _U(64 - _BITS))
        else:
            out.append(np.zeros(0, _U))
    return out


def pack(values: np.ndarray) -> bytes:
    """Six bytes a value."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(_U).ravel()


def needed(n1, n2):
    """Least intersection of linked sets of these sizes."""
    return -((-NUM * (n1 + n2)) // (NUM + DEN))


def counts(s: np.ndarray, size: int) -> bytes:
    """The set's elements by their last bits, counted up to 255."""
    return np.minimum(np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def coarse_size(n: int) -> int:
    """Buckets of a coarse sketch: with more than about eight elements in each, unlike sets look alike."""
    return max(SKETCH, 1 << min(12, max(0, n.bit_length() - 3)))


def sketches_meet(na: np.ndarray, nb: np.ndarray, sa: list[bytes], sb: list[bytes]) -> np.ndarray:
    """Whether sets of these sizes and coarse sketches may link; the longer sketch of a pair is folded to the shorter."""
    la, lb = (np.array(list(map(len, s)), np.int64) for s in (sa, sb))
    ok = np.zeros(len(na), bool)
    for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        these = np.flatnonzero((la == x) & (lb == y))
        for at in np.array_split(these, -(-len(these) * max(x, y) // 1_000_000)):
            p, q = (np.frombuffer(b"".join([s[i] for i in at]), np.uint8).reshape(len(at), -1, min(x, y)).sum(1, dtype=np.int32) for s in (sa, sb))
            ok[at] = na[at] + nb[at] - np.abs(p - q).sum(1) >= 2 * needed(na[at], nb[at])
    return ok


def _frequent(docs: DataFrame) -> np.ndarray:
    """At most ``FREQUENT`` shingles of high document frequency, rarest first.

    Every task counts all its documents' shingles, a million at a time, and reports those
    frequent among them."""

    def frequent(sets):
        value, n = np.unique(np.concatenate([*sets, np.zeros(0, _U)]), return_counts=True)
        some = n >= 4
        return pa.RecordBatch.from_arrays([pa.array(value[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["h", "n"])

    def count(batches):
        sets, size = [], 0
        for batch in batches:
            for run in X.chunks(batch.column(0)):
                more = shingle_sets(run)
                sets, size = sets + more, size + sum(map(len, more))
                if size > COUNTED_AT_ONCE:
                    yield frequent(sets)
                    sets, size = [], 0
        yield frequent(sets)

    total = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = total.where("n >= 64").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy().view(_U)[::-1].copy(), top.column("n").to_numpy()[::-1].copy()


def _order(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of each shingle in the global order: by hash, frequent ones after all others."""
    if not len(frequent):
        return s
    at = np.searchsorted(frequent, s)
    at[at == len(frequent)] = 0
    return np.where(frequent[at] == s, _TOP + rank[at].astype(_U), s)


def _sets_table(docs: DataFrame, shared) -> DataFrame:
    """(id, n, f1, f2, prefix, sketch, sig) per row: size, fingerprint and what the filters read."""

    def sets(batches):
        frequent, rank = shared.value
        salts = X.mix(np.arange(1, MINHASHES + 1, dtype=_U)) | _U(1)
        for batch in batches:
            ids = batch.column(0)
            for run in X.chunks(batch.column(1)):
                n, f1, f2, prefix, sketch, sig = [], [], [], [], [], []
                for s in shingle_sets(run):
                    m = X.mix(s + _U(11))
                    n.append(len(s))
                    f1.append(int(s.sum(dtype=_U).view(np.int64)))
                    f2.append(int(m.sum(dtype=_U).view(np.int64)))
                    p = len(s) - (-(-NUM * len(s) // DEN)) + 1 if len(s) else 0
                    prefix.append(pack(np.sort(_order(s, frequent, rank))[:p]))
                    sketch.append(counts(s, coarse_size(len(s))))
                    sig.append([int(x) for x in (m[:, None] * salts).min(0).view(np.int64)] if len(s) > 3 else [])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(run.lo, run.hi - run.lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                    names=["id", "n", "f1", "f2", "prefix", "sketch", "sig"],
                )

    return docs.mapInArrow(sets, "id long, n long, f1 long, f2 long, prefix binary, sketch binary, sig array<long>")


def _pivots(reps: DataFrame) -> DataFrame:
    """(a, b): each set and the most central set among those that share a min-hash with it."""
    sig = reps.select("id", F.posexplode("sig").alias("i", "v"))
    many = sig.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1")
    met = written(sig.join(many, ["i", "v"]), "set-join-minhash")
    central = met.groupBy("id").agg(F.sum(F.log2("c")).alias("central"))
    leader = met.join(central, "id").groupBy("i", "v").agg(F.max(F.struct("central", F.negative("id").alias("neg"))).alias("lead"))
    best = met.join(leader, ["i", "v"]).groupBy("id").agg(F.max("lead").alias("lead"))
    return best.select(F.col("id").alias("a"), F.negative(F.col("lead")["neg"]).alias("b")).where("a != b")


def _possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by size and by the small sketches of all sets."""
    slim = reps.select("id", "n", "sketch")
    of = lambda s: slim.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").where(F.greatest("na", "nb") * NUM <= F.least("na", "nb") * DEN)

    def bound(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            na, nb = (c[x].to_numpy(zero_copy_only=False) for x in ("na", "nb"))
            ok = pa.array(sketches_meet(na, nb, c["sa"].to_pylist(), c["sb"].to_pylist()), pa.bool_())
            yield pa.RecordBatch.from_arrays([c["a"].filter(ok), c["b"].filter(ok)], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(bound, "a long, b long")


def _of_pairs(pairs: DataFrame, docs: DataFrame, make) -> DataFrame:
    """``pairs`` with ``make(set)`` of either side as p and q.  Only documents in pairs (and the
    few that the bit table can't tell from them) send anything."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(ids))

    def send(batches):
        table = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(member(table, batch.column(0).to_numpy(zero_copy_only=False)), pa.bool_()))
            for run in X.chunks(batch.column(1)):
                sent = pa.array([make(s) for s in shingle_sets(run)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.lo, run.hi - run.lo), sent], names=["id", "s"])

    sent = docs.where("id is not null").mapInArrow(send, "id long, s binary")
    return pairs.join(sent.withColumnsRenamed({"id": "a", "s": "p"}), "a").join(sent.withColumnsRenamed({"id": "b", "s": "q"}), "b").select("a", "b", "p", "q")


def fine_sketch(s: np.ndarray) -> bytes:
    """Counts in about as many buckets as the set has elements (a power of two, 4096 at most), after its size."""
    return len(s).to_bytes(8, "little") + counts(s, 1 << min(12, max(4, len(s).bit_length() - 1)))


def fine_bound(p: bytes, q: bytes) -> float:
    """Upper bound of the Jaccard similarity from two fine sketches, or -1 if it is below the threshold."""
    n1, n2 = int.from_bytes(p[:8], "little"), int.from_bytes(q[:8], "little")
    x, y = (np.frombuffer(v, np.uint8, offset=8).astype(np.int32) for v in (p, q))
    size = min(len(x), len(y))
    both = (n1 + n2 - int(np.abs(x.reshape(-1, size).sum(0) - y.reshape(-1, size).sum(0)).sum())) // 2
    return both / max(1, n1 + n2 - both) if both >= needed(n1, n2) else -1.0


def _likely(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, bound) of the pairs that may link by their fine sketches."""

    def bound(batches):
        for batch in batches:
            c = np.array([fine_bound(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], float)
            ok = pa.array(c >= 0, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(c[c >= 0])], names=["a", "b", "bound"])

    return _of_pairs(pairs, docs, fine_sketch).mapInArrow(bound, "a long, b long, bound double")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def exact(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = unpack(x.as_buffer()), unpack(y.as_buffer())
                ok.append(len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return _of_pairs(pairs, docs, pack).mapInArrow(exact, "a long, b long")


#: An index entry: shingle, set, its pivot and size, the shingle's place in it, the parts of a split list, and what came before.
ENTRY = np.dtype([("h", "u8"), ("id", "i8"), ("lab", "i8"), ("n", "i4"), ("pos", "i4"), ("part", "i4"), ("own", "i4"), ("seen", "u8", (SEEN,))])
_PLACES = _U((1 << (_BITS + 1)) - 1)
_SEEN_SALTS = (X.mix(np.arange(101, 101 + SEEN, dtype=_U)) | _U(1))[:, None]


def seen_before(places: np.ndarray) -> np.ndarray:
    """For each place of a prefix, the least of the earlier places under each of ``SEEN``
    permutations (products with odd numbers modulo 2^48, so that equal minima are one
    shingle); 0 for the first place, which nothing precedes."""
    least = np.minimum.accumulate((places[None] * _SEEN_SALTS) & _PLACES, axis=1)
    return np.concatenate([np.zeros((SEEN, min(1, len(places))), _U), least[:, :-1]], axis=1).T


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: the high bytes of small ones compress whatever stands beside them."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


def pack_entries(e: np.ndarray) -> bytes:
    """Entries column by column, so that repeated and near values compress in the shuffle."""
    ids = np.diff(e["id"], prepend=0)
    return b"".join([pack(e["h"]), *(pack(e["seen"][:, k]) for k in range(SEEN)), planes(ids), planes(e["lab"] - e["id"]), *(planes(e[c]) for c in ("n", "pos", "part", "own"))])


def unpack_entries(data: pa.Buffer) -> np.ndarray:
    n = len(data) // (6 + 6 * SEEN + 8 + 8 + 16)
    e, at = np.zeros(n, ENTRY), 6 * n * (1 + SEEN)
    e["h"] = unpack(data[: 6 * n])
    for k in range(SEEN):
        e["seen"][:, k] = unpack(data[6 * n * (1 + k) : 6 * n * (2 + k)])
    e["id"] = np.cumsum(from_planes(data[at : at + 8 * n], np.int64, n))
    e["lab"] = from_planes(data[at + 8 * n : at + 16 * n], np.int64, n) + e["id"]
    at += 16 * n
    for k, c in enumerate(("n", "pos", "part", "own")):
        e[c] = from_planes(data[at + 4 * n * k : at + 4 * n * (k + 1)], np.int32, n)
    return e


def _entries(reps: DataFrame, shared, buckets: int, split: int = SPLIT) -> DataFrame:
    """Index entries packed by bucket of the shingle: one row per batch and bucket."""

    def index(batches):
        _, count = shared.value  # of frequent shingles, by rank
        parts = np.maximum(1, -(-count // split))
        for batch in batches:
            own = [unpack(v.as_buffer()) for v in batch.column(3)]
            size = np.array([len(x) for x in own], np.int64)
            if not size.sum():
                continue
            doc = np.repeat(np.arange(len(own)), size)
            e = np.zeros(len(doc), ENTRY)
            e["h"], e["pos"] = np.concatenate(own), np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            e["seen"] = np.concatenate([seen_before(x) for x in own])
            for k, c in enumerate(("id", "n", "lab")):
                e[c] = batch.column(k).to_numpy(zero_copy_only=False)[doc]
            often = e["h"] >= _TOP
            k = np.ones(len(e), np.int64)
            k[often] = parts[(e["h"][often] - _TOP).astype(np.int64)]
            pieces = [e[k == 1]]
            for x, kk in zip(e[k > 1], k[k > 1], strict=True):  # to every pair of parts that holds this entry's part
                mine = int(X.mix(np.array([x["id"]], np.int64).view(_U))[0] % _U(kk))
                more = np.repeat(x[None], kk)
                more["part"] = [1 + min(mine, j) * kk + max(mine, j) if j != mine else -1 - j for j in range(kk)]
                more["own"] = mine
                pieces.append(more)
            e = np.concatenate(pieces)
            b = (X.mix(e["h"] + e["part"].astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)) % _U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            e, b = e[order], b[order]
            cut = np.flatnonzero(np.diff(b)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(b[np.r_[0, cut]]), pa.array([pack_entries(x) for x in np.split(e, cut)], pa.binary())], names=["b", "e"])

    return reps.select("id", "n", "lab", "prefix").where("n > 3").mapInArrow(index, "b long, e binary")


def list_pairs(e: np.ndarray) -> np.ndarray:
    """Distinct candidate pairs (low id, high id) of a bucket's lists, without those that
    the list of an earlier common shingle has."""
    e = e[np.lexsort((e["n"], e["part"], e["h"]))]
    new = np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["part"][1:] != e["part"][:-1])]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(e)])
    mixed = np.maximum.reduceat(e["lab"], first) != np.minimum.reduceat(e["lab"], first)
    e = e[np.repeat(mixed, length)]  # lists with one answer for all are done
    if not len(e):
        return np.zeros((0, 2), np.int64)
    group = np.cumsum(np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["part"][1:] != e["part"][:-1])])
    n, pos, lab, ident, seen = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["lab"], e["id"], e["seen"]
    cross = e["part"] > 0
    rest = n - pos
    found = [np.zeros((0, 2), np.int64)]
    at = np.arange(len(e))
    d = 1
    while len(at):
        at = at[at + d < len(e)]
        at = at[(group[at + d] == group[at]) & (NUM * n[at + d] <= DEN * n[at])]  # the block of sizes ends
        j = at + d
        ok = (lab[at] != lab[j]) & (np.minimum(rest[at], rest[j]) >= needed(n[at], n[j]))
        if cross.any():  # within pairs of two parts, only entries of different parts meet
            ok &= ~cross[at] | (e["own"][at] != e["own"][j])
        left, right = at[ok], j[ok]
        fresh = ~((seen[left] == seen[right]) & (seen[left] != 0)).any(1)
        x, y = ident[left[fresh]], ident[right[fresh]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if sum(map(len, found)) > 2_000_000:
            found = [np.unique(np.concatenate(found), axis=0)]
        d += 1
    return np.unique(np.concatenate(found), axis=0)


def _candidates(entries: DataFrame) -> DataFrame:
    def pairs(table: pa.Table) -> pa.Table:
        e = np.concatenate([unpack_entries(v.as_buffer()) for v in table.column("e")])
        got = list_pairs(e)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return entries.groupBy("b").applyInArrow(pairs, "a long, b long").distinct()


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; lists over ``split`` entries are compared in parts."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent, count = _frequent(docs)
    by_hash = np.argsort(frequent)
    order = spark.sparkContext.broadcast((frequent[by_hash], by_hash))
    sets = written(_sets_table(docs, order), "set-join-table")
    same = ["n", "f1", "f2"]
    classes = sets.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"))
    classes = written(classes, "set-join-classes")
    reps = sets.join(classes.select(F.col("rep").alias("id"), *same), ["id", *same], "left_semi").dropDuplicates(["id", *same])
    slim = written(reps.select("id", "n", "sketch", "sig"), "set-join-reps")
    stars = written(_linked(written(_possible(_pivots(slim), slim), "set-join-pivots"), docs), "set-join-stars")
    labels = components(stars.withColumnsRenamed({"a": "u", "b": "v"})).withColumnsRenamed({"node": "id", "component": "lab"})
    labelled = reps.join(labels, "id", "left").withColumn("lab", F.coalesce("lab", "id"))
    total = slim.agg(F.sum(F.col("n") / F.lit(DEN) + 1)).first()[0] or 0
    buckets = max(16, int(total / BUCKET_ENTRIES) + 1)
    freq = spark.sparkContext.broadcast((frequent, count))
    pairs = _possible(_candidates(_entries(labelled, freq, buckets, split)), slim)
    likely = written(_likely(written(pairs, "set-join-pairs"), docs), "set-join-likely")
    # each set's likeliest partner first; then only pairs whose answer does not follow from those
    each = likely.select(F.col("a").alias("id"), "a", "b", "bound").unionByName(likely.select(F.col("b").alias("id"), "a", "b", "bound"))
    first = each.groupBy("id").agg(F.max(F.struct("bound", F.negative("a").alias("x"), F.negative("b").alias("y"))).alias("m"))
    first = first.select(F.negative(F.col("m")["x"]).alias("a"), F.negative(F.col("m")["y"]).alias("b")).distinct()
    first = written(first, "set-join-first")
    links = written(stars.unionByName(_linked(first, docs)), "set-join-links")
    so_far = components(links.withColumnsRenamed({"a": "u", "b": "v"}))
    of = lambda s: so_far.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    rest = likely.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = rest.join(first, ["a", "b"], "left_anti")
    found = components(links.unionByName(_linked(written(rest, "set-join-rest"), docs)).withColumnsRenamed({"a": "u", "b": "v"}))
    out = sets.select("id", *same).join(classes, same, "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each component, columns unchanged."""
    found = link_components(docs, id_col, text_col).where("doc_id is not null and component_id != doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
