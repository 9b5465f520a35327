"""Token counts of whole texts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is proved or refuted: it is a
*whole token* if the tokenizer's splitter keeps it in one piece and the
tokenizer encodes that piece as that single id.  A text is then split into
pre-tokens; each one that is a whole token counts one by a table lookup, and
only the rest goes through the tokenizer's merges, each distinct one once per
worker (the memo is bounded and starts again when full).  A piece is merged by
the tokenizer's model alone, its bytes spelled as the byte-level pre-tokenizer
spells them: splitting it again and the encoding's offsets cost more than the merges.

The splitter's pattern runs in Python's ``re`` for texts whose characters all
lie in ranges where its classes are known to agree with the tokenizer's own
(the tests compare every code point); any other text is split by the tokenizer.

Defined cases: null and empty texts count 0 tokens and 0 bytes; special
strings inside a text count as the tokenizer's default treats them (one added
token each); nothing is truncated; repeated rows each get their own count.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.shared import bounded_batches

MEMO_SIZE = 400_000

#: White space, and the numerals beyond ASCII digits, among the characters below U+0530.
_SPACE = r"\t-\r \x85\xa0"
_NUMERALS = "\xb2\xb3\xb9\xbc\xbd\xbe"
_LETTER = rf"[^\W\d_{_NUMERALS}]"
_DIGIT = rf"[\d{_NUMERALS}]"
_OTHER = rf"(?:[^\w{_SPACE}]|_)"
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?{_LETTER}+| ?{_DIGIT}+| ?{_OTHER}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Beyond these, texts are split by the tokenizer itself.
UNCOMMON = re.compile("[^\x00-ԯ]")
#: The character that byte-level tokenizers write for each byte: itself if it is visible, else the next from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELLED = {b: b if b in _VISIBLE else 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)) + _VISIBLE)}


class Counter:
    """Counts tokens of texts with one tokenizer; built in each worker from its JSON."""

    def __init__(self, spec: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        added = [t["content"] for t in json.loads(spec).get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = whole
        self.memo: dict[str, int] = dict.fromkeys(whole, 1)

    def split(self, piece: str) -> list[str]:
        if UNCOMMON.search(piece):
            return [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
        return SPLIT.findall(piece)

    def _sum(self, pre: list[str]) -> int:
        try:
            return sum(map(self.memo.__getitem__, pre))
        except KeyError:
            rest = [p for p in set(pre) if p not in self.memo]
        merge = self.tokenizer.model.tokenize
        for p in rest:
            self.memo[p] = len(merge(p.encode().decode("latin-1").translate(SPELLED)))
        return sum(map(self.memo.__getitem__, pre))

    def count(self, text: str) -> int:
        if len(self.memo) > len(self.whole) + MEMO_SIZE:
            self.memo = dict.fromkeys(self.whole, 1)
        pieces = self.special.split(text) if self.special else [text]
        return len(pieces) - 1 + sum(self._sum(self.split(p)) for p in pieces)


def whole_tokens(spec: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, proved one by one."""
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    tok = Tokenizer.from_str(spec)
    decoder, added = ByteLevel(), {t["content"] for t in json.loads(spec).get("added_tokens", ())}
    plain = {i: s for t, i in tok.get_vocab(with_added_tokens=False).items() if t not in added and "�" not in (s := decoder.decode([t]))}
    ids = sorted(plain)
    codes = tok.encode_batch([plain[i] for i in ids], add_special_tokens=False)
    return frozenset(
        plain[i] for i, enc in zip(ids, codes, strict=True) if enc.ids == [i] and len(tok.pre_tokenizer.pre_tokenize_str(plain[i])) == 1
    )


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of every whole text in ``out_col`` (an equally named column is replaced).

    ``tokenizer_path`` is a file of the ``tokenizers`` library with byte-level
    pre-tokens, read on the driver; its fixed size bounds the broadcast."""
    bounded_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    model = json.loads(spec)
    if (model["pre_tokenizer"] or {}).get("type") != "ByteLevel" or model["normalizer"] or model["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("token_counts needs a byte-level tokenizer without normaliser or prefix space")
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))
    docs = docs.drop(out_col)

    def count(batches):
        counter = Counter(*shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            counts = [counter.count(s) if (s := v.as_py()) else 0 for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())]))


def document_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select("doc_id", "text")
    counted = token_counts(rows, tokenizer_path).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
