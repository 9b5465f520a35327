"""Fill-in-the-middle transformation: cuts located by combining memoised chunk summaries.

A text's units are its tokens, a run of white space with the word after it, or
white space at the end.  To find where the u-th unit ends without walking every
text unit by unit, texts are cut into chunks where a rolling hash of the last 32
bytes meets a mask, so that equal passages give equal chunks wherever they stand.
A chunk's summary (characters, word ends inside, whether it starts with white
space and ends in a word) is kept under the chunk's own bytes: a chunk that many
texts share is summarised once a worker, and equality is that of the whole
content, never of a hash.  Summaries combine from left to right: a word also ends
where a chunk that ends in a word meets one that starts with white space.  The
running counts tell in which chunk a cut lies; only that chunk is searched.

The cut points come from one Arrow UDF that returns three numbers a text; drawing
the cuts, choosing the form, building the output and rebuilding the text
(``restored``) are column expressions.  No shuffle; a hot source costs no more than
other rows.  Rolling hashes are computed over ``SEGMENT`` bytes at a time and the
cache is bounded by ``CACHE_BYTES``, so memory beyond a text itself does not grow
with it.

Defined cases: null and empty texts have no units and stay plain; texts of white
space have one unit; texts that hold a sentinel stay plain; a null id counts as an
empty one; repeated rows each get their own (equal) result; rows of one id and
different texts draw the same numbers; an empty table gives no rows; the columns of
``transformed`` replace columns of the same names, all others are carried.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import text as X
from cohortlens.llm.shared import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80

MASK = 0x3FF << 22  # chunks of about 1,024 bytes, from the bits that all 32 bytes reach
LEAST, MOST = 256, 8_192
REACH = 32
SEGMENT = 1 << 20
CACHE_BYTES = 32 << 20

_rng = np.random.default_rng(20)
_GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_cuts(raw: np.ndarray) -> np.ndarray:
    """Positions where the rolling hash of the ``REACH`` bytes before them meets the mask, between characters."""
    found = []
    for lo in range(0, len(raw), SEGMENT):
        part = raw[max(0, lo - REACH) : lo + SEGMENT]
        h = _GEAR[part]
        for k in (1, 2, 4, 8, 16):  # sums over 2, 4, .. 32 bytes, older ones shifted further
            h[k:] += h[:-k] << np.uint32(k)
        hit = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1 + max(0, lo - REACH)
        found.append(hit[(hit > lo) & (hit < len(raw))])
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return at[(raw[at] & 0xC0) != 0x80]


def chunk_ends(raw: np.ndarray, at: np.ndarray) -> list[int]:
    """Ends of a text's chunks: hash cuts, none within ``LEAST`` of the last one, and one after ``MOST`` at the latest."""
    ends, last, n = [], 0, len(raw)
    while n - last > LEAST:
        k = int(np.searchsorted(at, last + LEAST))
        cut = int(at[k]) if k < len(at) else n
        if cut - last > MOST:
            cut = last + MOST
            while (raw[cut] & 0xC0) == 0x80:
                cut -= 1
        if cut >= n:
            break
        ends.append(cut)
        last = cut
    if n:
        ends.append(n)
    return ends


def word_ends(chunk: bytes) -> np.ndarray:
    """Positions inside a chunk where white space follows a word."""
    word = X.NON_SPACE[np.frombuffer(chunk, np.uint8)]
    return np.flatnonzero(word[:-1] & ~word[1:]) + 1


def characters(chunk: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))


class Summaries:
    """Boundary summaries by content: (characters, word ends inside, starts with space, ends in a word)."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.hits = limit, 0, 0
        self.of: dict[bytes, tuple[int, int, bool, bool]] = {}

    def get(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        if (known := self.of.get(chunk)) is not None:
            self.hits += 1
            return known
        made = (characters(chunk), len(word_ends(chunk)), not X.NON_SPACE[chunk[0]], bool(X.NON_SPACE[chunk[-1]]))
        if self.held > self.limit:
            self.of.clear()
            self.held = 0
        self.of[chunk] = made
        self.held += len(chunk) + 200
        return made


class Units:
    """A text's units, from the summaries of its chunks."""

    def __init__(self, data: bytes, ends: list[int], known: Summaries):
        self.data, self.bounds = data, [0, *ends]
        parts = [known.get(data[a:b]) for a, b in zip(self.bounds, ends, strict=False)]
        self.chars = [0, *accumulate(p[0] for p in parts)]
        in_word = [False, *(p[3] for p in parts)]
        #: Of each chunk: does a word end at its first byte's place, and the word ends up to its last byte.
        self.joint = [w and p[2] for w, p in zip(in_word, parts, strict=False)]
        self.upto = list(accumulate(p[1] + j for p, j in zip(parts, self.joint, strict=True)))
        words = (self.upto[-1] if parts else 0) + in_word[-1]
        self.n = int(words + (bool(parts) and not in_word[-1]))

    def end(self, u: int) -> int:
        """Characters up to the end of the u-th unit."""
        if u <= 0:
            return 0
        if not self.upto or u > self.upto[-1]:
            return self.chars[-1]
        k = int(np.searchsorted(self.upto, u))
        rank = u - (self.upto[k - 1] if k else 0) - self.joint[k]
        if rank == 0:
            return self.chars[k]
        chunk = self.data[self.bounds[k] : self.bounds[k + 1]]
        return self.chars[k] + characters(chunk[: word_ends(chunk)[rank - 1]])


def cut_points(texts: pa.Array, first: pa.Array, second: pa.Array, known: Summaries) -> pa.Array:
    """Per text: units, and characters of the prefix and of the middle, for two drawn numbers."""
    a, b = (np.asarray(x.fill_null(0), np.int64) for x in (first, second))
    out = np.zeros((len(texts), 3), np.int64)
    for run in X.chunks(texts):
        for row in range(run.hi - run.lo):
            raw = run.raw[run.off[row] : run.off[row + 1]]
            units = Units(raw.tobytes(), chunk_ends(raw, rolling_cuts(raw) if len(raw) > LEAST else raw[:0]), known)
            at = run.lo + row
            i, j = sorted((int(a[at]) % (units.n + 1), int(b[at]) % (units.n + 1)))
            lo, hi = units.end(i), units.end(j)
            out[at] = units.n, lo, hi - lo
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], ["n", "prefix_chars", "middle_chars"])


_KNOWN = Summaries()  # of this Python worker


def _in_worker(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    return cut_points(text, first, second, _KNOWN)


_cut_points = F.arrow_udf(_in_worker, T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")]))


def drawn(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(
    docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    bounded_batches(docs.sparkSession)
    own = ("n", "form", "prefix_chars", "middle_chars", "output", "fm_cut")
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = drawn(F.col(doc_id), seed)
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(text, F.lit(mark))
    form = F.when((text == "") | held | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c not in own]
    cut = docs.withColumns({"fm_cut": _cut_points(text, h1, h2), "form": form})
    p, m = F.col("fm_cut.prefix_chars").cast("int"), F.col("fm_cut.middle_chars").cast("int")
    prefix, middle = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m)
    suffix = F.substring(text, p + m + 1, F.char_length(text))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    given = lambda c: F.when(F.col("form") != "plain", F.col(f"fm_cut.{c}"))
    return cut.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("fm_cut.n").alias("n"),
        "form",
        given("prefix_chars").alias("prefix_chars"),
        given("middle_chars").alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.  A text in parts holds no sentinel, so each one's first occurrence is the real one."""
    at = lambda mark: F.instr(output, mark)
    whole = F.char_length(output)
    piece = lambda lo, hi: F.substring(output, lo + 3, hi - lo - 3)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    middle = F.substring(output, m + 3, whole)
    psm = F.concat(piece(p, s), middle, piece(s, m))
    spm = F.concat(piece(p, m), middle, piece(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def document_fim(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = transformed(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
