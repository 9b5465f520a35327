"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items, as sequences of normalised words, go into suffix
automata, one per block of about ``block_words`` words (a longer item is in a block
with what else falls there).  Items are dealt to blocks by their hash, so Spark
reads the benchmark a block at a time and what is broadcast is bounded whatever its
size; a worker builds a block's automaton once for all its tasks.  A benchmark of
one block takes one narrow pass over the documents: no shuffle, no join, and a hot
source or a common passage costs no more than any other rows.  With more, each
block's hits, of the rows that have any, are a written table of its own, and the
union of them is joined to the documents by row.

A window is ``window`` consecutive words of an item; an item of fewer words
(but not none) is a window as a whole.  Every document word inside an
occurrence of a window is hit.

Within a task, hashes of the shortest window's length over all words find the
stretches that can hold a match (no false negatives); the automaton then walks
those stretches word by word, tracks the longest match that ends at each word,
and decides.

Defined cases: null and empty texts have no words and no hits; an empty
benchmark hits nothing; repeated document rows each get their own result;
repeated items with one id count once; items with a null id count like others, as one
item, whose id is not listed; null and empty items have no windows; columns of the documents beyond those
asked for are carried or dropped by name, never mixed up with the results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import text as X
from cohortlens.llm.shared import bounded_batches, written

WINDOW = 10
BLOCK_WORDS = 200_000

_SPANS = "array<struct<start:bigint,end:bigint>>"


class Automaton:
    """Generalised suffix automaton over word hashes, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        self.of_window: dict[tuple[int, ...], set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        kept = [(i, w) for i, w in items if w]
        for _, seq in kept:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        for item, seq in kept:
            if len(seq) < window:
                state = 0
                for word in seq:
                    state = self.next[state][word]
                self.short.setdefault(state, []).append((len(seq), item))
            for j in range(len(seq) - window + 1):
                self.of_window.setdefault(tuple(seq[j : j + window]), set()).add(item)
        self.least = min((min(len(w), window) for _, w in kept), default=0)
        grams = [X.combine(np.array(w, np.uint64), self.least) for _, w in kept]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, q, word)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return cur

    def _clone(self, p: int, q: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, longest match ending there, its state) for each word."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for end, word in enumerate(seq, 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state, matched = nxt[state][word], matched + 1
            yield end, matched, state

    def hits(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Word spans inside occurrences of windows, and the items they are from."""
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        for end, matched, state in self.stream(seq):
            if matched >= self.window:
                spans.append((end - matched, end))
                found |= self.of_window.get(tuple(seq[end - self.window : end]), set())
            while self.short and state > 0:
                for size, item in self.short.get(state, ()):
                    if matched >= size:
                        spans.append((end - size, end))
                        found.add(item)
                state = self.link[state]
        return spans, found


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def candidates(w: X.Words, auto: Automaton) -> Iterator[tuple[int, int, int]]:
    """(row, first word, end) of the stretches of a run whose every n-gram is a benchmark n-gram."""
    m = auto.least
    if not m or len(w.hash) < m:
        return
    grams = X.combine(w.hash, m)
    at = np.searchsorted(auto.grams, grams)
    at[at == len(auto.grams)] = 0
    ok = (auto.grams[at] == grams) & (w.row[: len(grams)] == w.row[m - 1 :])
    pos = np.flatnonzero(ok)
    if not len(pos):
        return
    cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(w.row[pos]) != 0)) + 1
    for part in np.split(pos, cut):
        yield int(w.row[part[0]]), int(part[0]), int(part[-1]) + m


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of about ``block_words`` words, by the hash of id and text."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    words = rows.agg(F.sum(F.size(F.split("t", r"\s+")) + 1)).first()[0]  # no fewer than the items' words
    n = -(-(words or 0) // block_words)
    for k in range(n):
        if block := [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).sort("i", "t").collect()]:
            yield block


def _automaton(block: list[tuple[str | None, str]], window: int) -> Automaton:
    items = []
    for item, txt in block:
        (run,) = X.chunks(pa.array([txt]))
        items.append((item, X.words(run, X.ALNUM).hash.tolist()))
    return Automaton(items, window)


_built: dict[str, Automaton] = {}  # the block last used by this Python worker


def _automaton_of(key: str, block: list[tuple[str | None, str]], window: int) -> Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = _automaton(block, window)
    return _built[key]


def _shared(spark, block: list[tuple[str | None, str]], window: int):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block, window))


_OWN = ("dc_words", "dc_spans", "dc_items", "dc_row")


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` with ``dc_words`` (word count), ``dc_spans`` (merged word spans that are hit)
    and ``dc_items`` (sorted ids of items with occurring windows, a null id first).  With
    ``removed``, also a column of that name: the text without the hit spans' bytes."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in _OWN if c in docs.columns))
    blank = {"dc_spans": F.array().cast(_SPANS), "dc_items": F.array().cast("array<string>")}
    blocks = item_blocks(benchmark, item_id, item_text, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        rows = docs.withColumns(blank)
        return _passed(rows, _shared(spark, first, window) if first else None, text_col, removed)
    docs = written(docs, "decontaminate").withColumn("dc_row", F.monotonically_increasing_id())
    texts = docs.select("dc_row", F.col(text_col).alias("text")).withColumns(blank)
    hits = []
    for block in chain((first, second), blocks):
        shared = _shared(spark, block, window)
        found = _passed(texts, shared, "text", None).where(F.size("dc_spans") > 0).select("dc_row", "dc_spans", "dc_items")
        hits.append(written(found, "hits"))
        shared.destroy()
    per_row = reduce(DataFrame.unionByName, hits).groupBy("dc_row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in blank))  # a document's own hits
    rows = docs.join(per_row, "dc_row", "left").withColumns({c: F.coalesce(c, v) for c, v in blank.items()})
    return _passed(rows.drop("dc_row"), None, text_col, removed)


def _passed(rows: DataFrame, shared, text_col: str, removed: str | None) -> DataFrame:
    """One pass: the spans and items that rows have, with those of a block's automaton, and the words counted."""
    fields = [*rows.schema.fields, T.StructField("dc_words", T.LongType()), *([T.StructField(removed, T.StringType())] if removed else [])]
    names = [f.name for f in fields]

    def run_pass(batches):
        auto = _automaton_of(*shared.value) if shared else None
        for batch in batches:
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("dc_spans").to_pylist()]
            items = [set(x) for x in batch.column("dc_items").to_pylist()]
            texts = batch.column(text_col)
            counts = np.zeros(len(spans), np.int64)
            kept: list[str | None] = [None] * len(spans)
            for run in X.chunks(texts):
                w = X.words(run, X.ALNUM)
                counts[run.lo : run.hi] = w.count
                for row, a, b in candidates(w, auto) if auto else ():
                    got, found = auto.hits(w.hash[a:b].tolist())
                    base = a - int(w.first[row])
                    spans[run.lo + row] += [(x + base, y + base) for x, y in got]
                    items[run.lo + row] |= found
                for row in range(run.hi - run.lo):
                    k = run.lo + row
                    spans[k] = merged(spans[k])
                    if removed and texts[k].is_valid:
                        kept[k] = _without(run, w, row, spans[k]) if spans[k] else texts[k].as_py()
            cols = {
                "dc_words": pa.array(counts),
                "dc_spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "dc_items": pa.array([sorted(x, key=lambda i: (i is not None, i)) for x in items], pa.list_(pa.string())),
                removed: pa.array(kept, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run_pass, T.StructType(fields))


def _without(run: X.Run, w: X.Words, row: int, spans: list[tuple[int, int]]) -> str:
    """The row's text without the bytes from each span's first word to its last one's end."""
    first, at = int(w.first[row]), int(run.off[row])
    cuts = [at]
    for a, b in spans:
        cuts += [int(w.start[first + a]), int(w.end[first + b - 1])]
    cuts.append(int(run.off[row + 1]))
    return b"".join(run.raw[a:b].tobytes() for a, b in list(pairwise(cuts))[::2]).decode("utf-8", "replace")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = matches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    n_hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "dc_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("dc_spans") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    max_coverage: float = 0.5,
    **options,
) -> DataFrame:
    """``docs`` without contamination, columns unchanged: a document covered by more than
    ``max_coverage`` of its words goes; from the others, every hit span goes from the text."""
    kept = "dc_text"
    rows = matches(docs, benchmark, text_col=text_col, removed=kept, **options)
    n_hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = rows.where(n_hit <= F.col("dc_words") * F.lit(max_coverage))
    return rows.select(*(F.col(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
