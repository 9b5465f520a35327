"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded, documented sample of labelled texts (``per_class`` of each label)
becomes the example set.  Terms are words and word beginnings; every term that two
examples hold is indexed, whatever its labels.  A term's evidence (log likelihood
ratio of its label counts) raises its TF-IDF weight and never drops it.  A text is
compared with all examples that share a term with it, by inverted lists (the lists
of frequent terms are columns of a matrix), so the result is exact.  The neighbours
vote with weights that fall with distance and undo the sampling by class, a toxic
one by the part of its cosine that rests on evidence; an isotonic fit on
leave-one-out votes turns the vote into a calibrated score.  The nearest examples
are returned as evidence.  The driver holds the lists alone; what the search derives
from them is made in the tasks, which also compute the leave-one-out votes.

Defined cases: null and empty texts, and texts without any indexed term,
have no neighbours and get the calibrated rate of such examples (of a vote of 0
without any); ties in
cosine go to the example that comes first in the index; without labelled
examples of both classes every score is the share of label 1 (0 without any);
repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import text as X
from cohortlens.llm.shared import bounded_batches, written

PER_CLASS = 2500
#: Examples that hold a term for it to be indexed.
LEAST_DF = 2
#: Evidence (log likelihood ratio of a term's label counts against the sample's share) that counts in full,
#: and the weight of a term without any.
FULL_EVIDENCE = 18.0
NO_EVIDENCE = 0.05
NEIGHBOURS = 15
#: Terms of more than a DENSE-th of the examples are matrix columns; queries multiplied at a time.
DENSE = 10
TOGETHER = 32
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
_U = np.uint64
_LETTERS = X.byte_table(b for b in range(256) if b >= 0x80 or chr(b).isalpha())


def terms(run: X.Run) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every word and word beginning of a run."""
    w = X.words(run, _LETTERS)
    pre, (_, down) = X.prefix_hash(X.LOWER_AZ[run.raw]), X.powers(len(run.raw) + 1)
    rows, hashes = [w.row], [w.hash]
    for n in PREFIXES:
        s = w.start[w.end - w.start > n]
        rows.append(w.row[w.end - w.start > n])
        hashes.append(X.mix((pre[s + n] - pre[s]) * down[s] + _U(n << 40)))
    return np.concatenate(rows), np.concatenate(hashes)


#: What ``Index`` derives from its fields, on first use.
_DERIVED = frozenset({"bucket", "longest", "padded", "df", "wide_of", "upto", "slot", "column", "dense"})


@dataclass
class Index:
    """Examples' unit vectors as inverted lists: term ``t`` has ``of[first[t]:first[t + 1]]`` with their weights.

    Only these fields are sent; the search's own tables are made from them where it runs."""

    vocab: np.ndarray  # sorted term hashes
    idf: np.ndarray  # with the evidence weight
    sure: np.ndarray  # evidence of each term, 0 to 1
    first: np.ndarray
    of: np.ndarray
    value: np.ndarray
    label: np.ndarray
    example: np.ndarray  # evidence ids
    class_weight: tuple[float, float]
    base: float
    steps: tuple[np.ndarray, np.ndarray] | None = None  # isotonic: vote bounds, scores
    no_terms: float = 0.0

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __getattr__(self, name: str):
        if name not in _DERIVED or "vocab" not in self.__dict__:
            raise AttributeError(name)
        self._derive()
        return self.__dict__[name]

    def _derive(self) -> None:
        # Terms by the first 20 bits of their hash: each range of the sorted hashes is a few long.
        self.bucket = np.searchsorted(self.vocab >> _U(44), np.arange((1 << 20) + 1, dtype=_U)).astype(np.int32)
        self.longest = int(np.diff(self.bucket).max())
        self.padded = np.r_[self.vocab, np.zeros(self.longest + 1, _U)]
        self.df = np.diff(self.first)
        self.wide_of, self.upto = self.of.astype(np.int64), np.arange(1 << 18)  # as numpy's sums by place want them
        self.slot = np.full(len(self.label), -1, np.int32)  # scratch: places of the examples looked at
        often = np.flatnonzero(self.df > len(self.label) / DENSE)
        self.column = np.full(len(self.vocab), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(self.label), len(often)), np.float32)
        for k, t in enumerate(often):
            self.dense[self.of[self.first[t] : self.first[t + 1]], k] = self.value[self.first[t] : self.first[t + 1]]

    @property
    def weight(self) -> np.ndarray:
        """The whole matrix (terms x examples), for small indexes."""
        out = np.zeros((len(self.vocab), len(self.label)), np.float32)
        out[np.repeat(np.arange(len(self.vocab)), self.df), self.of] = self.value
        return out

    def vectors(self, run: X.Run):
        """(row, term positions, unit weights) of the rows that hold an indexed term."""
        row, h = terms(run)
        b = (h >> _U(44)).astype(np.int32)
        first, end = self.bucket[b], self.bucket[b + 1]
        near = first < end
        row, h, first, end = row[near], h[near], first[near], end[near]
        at, ok = first.astype(np.int64), np.zeros(len(h), bool)
        for k in range(self.longest):
            here = (self.padded[first + k] == h) & (first + k < end)
            at[here] = first[here] + k
            ok |= here
        key, tf = np.unique(row[ok] * len(self.vocab) + at[ok], return_counts=True)
        row, at = key // max(len(self.vocab), 1), key % max(len(self.vocab), 1)
        cut = np.flatnonzero(np.diff(row)) + 1
        for r, t, n in zip(np.split(row, cut), np.split(at, cut), np.split(tf, cut), strict=True):
            if len(r):
                q = (1 + np.log(n)) * self.idf[t]
                yield int(r[0]), t, q / np.linalg.norm(q)

    def _lists(self, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples and products of the lists of these terms."""
        n = self.df[at]
        ends = np.cumsum(n)
        where = np.repeat(self.first[at] - (ends - n), n)
        where += self.upto[: len(where)] if len(where) <= len(self.upto) else np.arange(len(where))
        return self.wide_of.take(where, mode="clip"), self.value.take(where, mode="clip") * np.repeat(q, n)

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None):
        """For each query (term positions, weights), its exact k nearest examples with a positive cosine:
        (positions, cosines, parts of the cosines that rest on evidence)."""
        for lo in range(0, len(queries), TOGETHER):
            some = queries[lo : lo + TOGETHER]
            wide = np.zeros((len(some), self.dense.shape[1]), np.float32)
            for i, (at, q) in enumerate(some):
                often = self.column[at] >= 0
                wide[i, self.column[at[often]]] = q[often]
            rough = wide @ self.dense.T
            for i, (at, q) in enumerate(some):
                rare = self.column[at] < 0
                of, product = self._lists(at[rare], q[rare])
                sums = np.bincount(of, product, len(self.label))
                cos = rough[i] + sums
                if skip is not None:
                    cos[skip[lo + i]] = 0
                # the products of frequent terms are single precision: whatever may be among the k is summed again
                least = np.partition(cos, -k)[-k] if len(cos) > k else 0.0
                cols = np.flatnonzero((cos >= least - 1e-5) & (cos > 0))
                yield self._exact(at, q, rare, of, product, sums, cols, k)

    def _exact(self, at, q, rare, of, product, sums, cols, k):
        """Cosines of these examples, and the parts that rest on evidence, in double precision: the lists'
        products as they are, those of frequent terms again."""
        often = at[~rare]
        mine = self.dense[cols][:, self.column[often]].astype(np.float64)
        cos = sums[cols] + mine @ q[~rare]
        part = mine @ (q[~rare] * self.sure[often])
        self.slot[cols] = np.arange(len(cols))
        here = np.flatnonzero(self.slot[of] >= 0)
        term = at[rare][np.searchsorted(np.cumsum(self.df[at[rare]]), here, side="right")]
        part += np.bincount(self.slot[of[here]], product[here] * self.sure[term], len(cols))
        self.slot[cols] = -1
        top = np.lexsort((cols, -cos))[:k]
        return cols[top], cos[top], part[top]

    def nearest(self, at: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return next(self.nearest_of([(at, q)], k))

    def vote(self, at: np.ndarray, cos: np.ndarray, part: np.ndarray) -> float:
        y = self.label[at]
        w = np.where(y == 1, self.class_weight[1], self.class_weight[0]) / (1.05 - np.minimum(cos, 1))
        return float((w * y * part / cos).sum() / w.sum())

    def score(self, vote: float) -> float:
        if self.steps is None:
            return vote
        bounds, values = self.steps
        return float(np.interp(vote, bounds, values))

    def votes_without(self, own: np.ndarray) -> np.ndarray:
        """The votes of these examples with each left out of its own search; NaN for one without neighbours."""
        wanted = np.flatnonzero(np.isin(self.of, own))
        order = wanted[np.lexsort((wanted, self.of[wanted]))]  # the vectors by example, terms in order
        term, value = np.searchsorted(self.first, order, side="right") - 1, self.value[order].astype(float)
        ends = np.searchsorted(self.of[order], own, side="right")
        starts = np.searchsorted(self.of[order], own, side="left")
        vectors = [(term[a:b], value[a:b]) for a, b in zip(starts, ends, strict=True)]
        return np.array([self.vote(*near) if len(near[0]) else np.nan for near in self.nearest_of(vectors, skip=own.tolist())], float)

    def calibrate(self, left_out: np.ndarray) -> None:
        """A weighted isotonic fit of the examples' leave-one-out votes."""
        votes, weights, labels, none = [], [], [], np.zeros(2)
        for y, vote in zip(self.label.tolist(), left_out.tolist(), strict=True):
            if vote == vote:
                votes.append(vote)
                weights.append(self.class_weight[y])
                labels.append(y)
            else:
                none[y] += self.class_weight[y]
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # vote sum, label sum, weight: adjacent violators are pooled
        for i in order:
            pools.append([votes[i] * weights[i], labels[i] * weights[i], weights[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.steps = (np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools]))
        self.no_terms = float(none[1] / none.sum()) if none.sum() else self.score(0.0) if pools else self.base


def inverted(vectors: pa.Table, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, of, value) of the examples' vectors (at, tf: a row each), whose weights are put in place row by row:
    beside the vectors and the lists nothing of their size is held."""
    size = np.zeros(len(idf) + 1, np.int64)
    for a in vectors.column("at"):
        size[np.frombuffer(a.as_buffer(), np.int32) + 1] += 1  # a vector holds a term once
    first = np.cumsum(size)
    free = first.copy()
    of, value = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.float32)
    for k, (a, b) in enumerate(zip(vectors.column("at"), vectors.column("tf"), strict=True)):
        at = np.frombuffer(a.as_buffer(), np.int32)
        w = (1 + np.log(np.frombuffer(b.as_buffer(), np.int32))) * idf[at]
        of[free[at]], value[free[at]] = k, w / max(np.linalg.norm(w), 1e-12)
        free[at] += 1
    return first, of, value


def left_out_votes(spark: SparkSession, index: Index) -> np.ndarray:
    """The leave-one-out vote of every example, computed in tasks."""
    shared = spark.sparkContext.broadcast(index)
    n = len(index.label)

    def vote(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.votes_without(own))], names=["id", "vote"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, n // TOGETHER))
    got = spark.range(0, n, 1, tasks).mapInArrow(vote, "id long, vote double").toArrow().sort_by("id")
    shared.destroy()
    return got.column("vote").to_numpy()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> Index:
    """Index of at most ``per_class`` distinct texts of each label; ``labels`` holds (id, 0/1)."""
    bounded_batches(docs.sparkSession)
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    lab = lab.groupBy("i").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1_all = n.get(0, 0), n.get(1, 0)
    base = n1_all / (n0 + n1_all) if n else 0.0
    drawn = F.xxhash64(F.lit("toxicity"), "i")
    parts = [lab.where(F.col("y") == y).orderBy(drawn, "i").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(ids, "i")
    texts = written(texts.groupBy("t").agg(F.min("i").alias("i"), F.max("y").alias("y")), "toxicity-examples")

    def found(run):
        """(row, term, count), by row."""
        row, h = terms(run)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, np.int64)
        return row[first], h[first], np.diff(np.r_[first, len(row)])

    def count(batches):
        for batch in batches:
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for run in X.chunks(batch.column(0)):
                row, h, _ = found(run)
                yield pa.RecordBatch.from_arrays([pa.array(y[run.lo + row].astype(np.int32)), pa.array(h.view(np.int64))], names=["y", "f"])

    examples = texts.select("i", "y").orderBy("i").toArrow()
    ids, label = examples.column("i").to_numpy(), examples.column("y").to_numpy().astype(int)
    m1, m0 = int((label == 1).sum()), int((label == 0).sum())
    n = max(1, m1 + m0)
    seen = texts.mapInArrow(count, "y int, f long").groupBy("f").agg(F.count("*").alias("df"), F.sum("y").alias("n1")).where(F.col("df") >= LEAST_DF).toArrow()
    hashes = seen.column("f").to_numpy().view(_U)
    order = np.argsort(hashes)
    hashes, df, n1 = hashes[order], seen.column("df").to_numpy()[order].astype(float), seen.column("n1").to_numpy()[order].astype(float)
    part = lambda k, share: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(df * share, 1e-12)), 0.0)
    sure = np.clip((part(n1, m1 / n) + part(df - n1, m0 / n)) / FULL_EVIDENCE, 0, 1)
    idf = (1 + np.log((1 + n) / (1 + df))) * (NO_EVIDENCE + sure)
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def place(batches):
        vocab = shared.value
        for batch in batches:
            i = batch.column(1)
            for run in X.chunks(batch.column(0)):
                row, h, tf = found(run)
                at = np.searchsorted(vocab, h)
                at[at == len(vocab)] = 0
                ok = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
                cut = np.searchsorted(row[ok], np.arange(1, run.hi - run.lo))
                sent = [pa.array([x.astype(np.int32).tobytes() for x in np.split(v[ok], cut)], pa.binary()) for v in (at, tf)]
                yield pa.RecordBatch.from_arrays([i.slice(run.lo, run.hi - run.lo), *sent], names=["i", "at", "tf"])

    sent = texts.mapInArrow(place, "i long, at binary, tf binary").toArrow().sort_by("i")  # at most 2 * per_class rows
    first, of, value = inverted(sent, idf)
    sent = None
    pa.default_memory_pool().release_unused()
    class_weight = (n0 / max(1, m0), n1_all / max(1, m1))
    index = Index(hashes, idf, sure, first, of, value, label, ids, class_weight, base)
    del of, value
    index.no_terms = base
    index.calibrate(left_out_votes(docs.sparkSession, index))
    return index


def score(docs: DataFrame, index: Index, text_col: str = "text", score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
    """``docs`` with the score and its evidence (nearest examples: id, label, cosine); equally named columns are replaced."""
    docs = docs.drop(score_col, evidence_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("example", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run_score(batches):
        index = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, index.no_terms)
            evidence: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for run in X.chunks(batch.column(batch.schema.get_field_index(text_col))):
                vectors = list(index.vectors(run))
                for (row, _, _), (near, cos, part) in zip(vectors, index.nearest_of([(at, q) for _, at, q in vectors]), strict=True):
                    if len(near):
                        scores[run.lo + row] = index.score(index.vote(near, cos, part))
                        evidence[run.lo + row] = [
                            {"example": int(index.example[a]), "label": int(index.label[a]), "cosine": round(float(c), 6)} for a, c in zip(near[:3], cos[:3], strict=True)
                        ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array(evidence, kind)], names=[*batch.schema.names, score_col, evidence_col]
            )

    element = T.StructType([T.StructField("example", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    fields = [T.StructField(score_col, T.DoubleType()), T.StructField(evidence_col, T.ArrayType(element))]
    return docs.mapInArrow(run_score, T.StructType([*docs.schema.fields, *fields]))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.3), evidence."""
    index = fit(docs, labels.where(~held_out()), **options)
    rows = score(docs.select("doc_id", held_out().alias("held_out"), "text"), index)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents predicted toxic, columns unchanged; held-out rows stay unlearned."""
    index = fit(docs, labels.where(~held_out()), **options)
    rows = score(docs, index, score_col="tox_score", evidence_col="tox_evidence").where(F.col("tox_score") < THRESHOLD)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
