"""Language identification with a bit-sliced Bloom filter of n-grams.

Each language's profile is its most frequent character n-grams.  All profiles
share one table of bit masks: bit l of a slot belongs to language l's Bloom
filter, so one probe returns the slot's bits for every language at once, and
the AND over the probes of an n-gram is the set of all languages containing
it.  Per text, the masks' popcounts per language, corrected for each filter's
false-positive rate, decide; the score is the winner's share of all languages'
corrected counts.

The model is fitted on a documented bounded sample: about ``docs_per_lang``
labelled documents per language, chosen by a hash of their text.  Its size is
fixed by ``profile`` and ``bits``, so the broadcast does not grow with data.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a text none of whose n-grams is in a profile gets the most frequent learned
language with score 0; ties go to the language first in code-point order;
without labelled documents every text with a letter is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import text as X
from cohortlens.llm.shared import bounded_batches, written

DOCS_PER_LANG = 2000
PROFILE = 8000
BITS = 19
PROBES = 2
SIZES = (3, 4)
CHUNK = 500_000
UND = "und"
_U = np.uint64
_SEEDS = tuple(_U(s) for s in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0x8CB92BA72F3D8DD7))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of all n-grams of letters and single spaces, and whether each text has a letter."""
    joined = "\0".join(texts).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = codes == 0
    letter = X.letter_table()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of each run of other characters, the first stands for one space
    kept |= breaks
    row = np.cumsum(breaks)[kept]
    symbol = np.where(letter, codes, 32)[kept].astype(_U)
    row_of = np.minimum(row, max(len(texts) - 1, 0))
    has = np.zeros(len(texts), bool)
    has[row_of[letter[kept]]] = True
    hashes, rows = [], []
    for n in SIZES:
        h = X.combine(symbol + _U(n << 32), n)
        same = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
        hashes.append(h[same])
        rows.append(row_of[: len(h)][same])
    return np.concatenate(hashes), np.concatenate(rows), has


def text_runs(column: pa.Array):
    """(lo, hi, texts) of runs of rows whose characters stay under a bound; nulls and NULs read as spaces."""
    lo, size, out = 0, 0, []
    for k, value in enumerate(column):
        s = (value.as_py() or "").replace("\0", " ")
        if out and size + len(s) > CHUNK:
            yield lo, k, out
            lo, size, out = k, 0, []
        out.append(s)
        size += len(s)
    if out:
        yield lo, len(column), out


@dataclass
class Model:
    """``table[word, slot]`` holds bit l % 64 of word l // 64 for language l."""

    langs: list[str]
    fallback: str
    table: np.ndarray
    false_positive: np.ndarray

    def slots(self, h: np.ndarray):
        shift = _U(64 - int(self.table.shape[1]).bit_length() + 1)
        for seed in _SEEDS[:PROBES]:
            yield ((h * seed) >> shift).astype(np.int64)

    def masks(self, h: np.ndarray, word: int) -> np.ndarray:
        out = np.full(len(h), ~_U(0))
        for at in self.slots(h):
            out &= self.table[word][at]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, row, has = grams(texts)
        n = np.bincount(row, minlength=len(texts)).astype(float)
        counts = np.zeros((len(self.langs), len(texts)))
        for word in range(len(self.table)):
            mask = self.masks(h, word)
            for bit, at in enumerate(range(64 * word, min(64 * word + 64, len(self.langs)))):
                hit = row[((mask >> _U(bit)) & _U(1)).astype(bool)]
                fp = self.false_positive[at]
                counts[at] = np.maximum(0, np.bincount(hit, minlength=len(texts)) - n * fp) / (1 - fp)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        best = counts.argmax(0)
        top = counts.max(0)
        with np.errstate(all="ignore"):
            score = np.where(has & (top > 0), top / counts.sum(0), 0.0)
        langs = [UND if not ok else self.langs[b] if t > 0 else self.fallback for ok, b, t in zip(has, best, top, strict=True)]
        return langs, score


def fit(labelled: DataFrame, text_col: str, lang_col: str, docs_per_lang: int = DOCS_PER_LANG, profile: int = PROFILE, bits: int = BITS) -> Model:
    """Fit on about ``docs_per_lang`` documents of each language of ``labelled``."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("l") == lang, docs_per_lang / counts[lang]).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("lang-id"), F.col("t")), F.lit(1_000_003)) / 1_000_003
    sample = rows.where(drawn < share)

    def count(batches):
        for batch in batches:
            langs_of = batch.column(1).to_pylist()
            for lo, _, texts in text_runs(batch.column(0)):
                h, row, _ = grams(texts)
                for lang in sorted(set(langs_of[lo : lo + len(texts)])):
                    of = np.array([x == lang for x in langs_of[lo : lo + len(texts)]])
                    value, n = np.unique(h[of[row]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["l", "h", "n"]
                    )

    total = sample.mapInArrow(count, "l string, h long, n long").groupBy("l", "h").agg(F.sum("n").alias("n"))
    total = written(total, "lang-id-grams")
    table = np.zeros(((len(langs) + 63) // 64, 1 << bits), _U)
    model = Model(langs, max(langs, key=lambda x: (counts[x], x), default=UND), table, np.zeros(len(langs)))
    for k, lang in enumerate(langs):
        top = total.where(F.col("l") == lang).orderBy(F.desc("n"), "h").limit(profile).select("h").toPandas()
        for at in model.slots(top.h.to_numpy(np.int64).view(_U)):
            np.bitwise_or.at(table[k // 64], at, _U(1 << (k % 64)))
        full = np.count_nonzero((table[k // 64] >> _U(k % 64)) & _U(1)) / table.shape[1]
        model.false_positive[k] = full**PROBES
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; equally named columns are replaced."""
    docs = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = [], [np.zeros(0)]
            for _, _, texts in text_runs(batch.column(batch.schema.get_field_index(text_col))):
                got, score = shared.value.predict(texts)
                langs += got
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*batch.schema.names, lang_col, score_col]
            )

    fields = [*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))


def document_languages(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id mod 5 is 0; never learned from), lang_pred, score."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out)
    model = fit(rows.where("not held_out"), "text", "lang", **options)
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
