"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is cut into passages: paragraphs, cut further at sentence and clause ends
of any script, each with its closing mark.  A passage over ``LONGEST`` characters
is cut by its content: after words whose hash is 0 modulo ``WORDS``, and what is
still longer (no spaces) after characters whose hash is 0 modulo ``CHARACTERS``, so
that texts without punctuation share passages, too.  Every passage is hashed to a wide vector:
64 small lanes, and ``WIDE`` lanes of 31 bits.  A fingerprint is the
sum of its passages' vectors, lane by lane, modulo 2^16 and 2^31.  Order does
not matter, equal multisets of passages have equal fingerprints, and adding or
removing a passage adds or subtracts its vector (``combine``).

The small lanes add a passage's weight (the whole root of its length, at most
``HEAVIEST``) where its hash has a one, and double as a sketch: twice a lane minus
the total weight is a random-sign sum, so the normalised inner product of two
fingerprints estimates which share of the texts' characters lies in common
passages.  ``likeness`` is that estimate cut to 0..1, and exactly 1 for equal
fingerprints.

A text's passages are summed in segments of 2^11, whose packed sums can't
overflow; segments are unpacked before they are added up, so texts may be of
any length.

Defined cases: null texts are empty; an empty text has one empty passage;
documents with one id are ordered by a hash of their text; null ids come last;
a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = 8
SEGMENT_BITS = 11
#: 2^11 passages of this weight stay below 2^16.
HEAVIEST = 31
LONGEST = 80
WORDS = 8
CHARACTERS = 16
PASSAGE_END = r"(?<=[\n.!?,;:|…。．｡！？，、､；：।॥؟،؛۔።፣])"
WORD_END = r"(?<=\s)(?=\S)"
#: Marks a cut inside a long passage and stays in it.
_CUT = "\x1f"
_ONES = 0x0001000100010001
_PAIR = 0x0000FFFF0000FFFF


def _cut(passage: Column, unit_end: str, share: int) -> Column:
    """The passage cut after the units whose hash is 0 modulo ``share``."""
    marked = F.transform(F.split(passage, unit_end), lambda u: F.when(F.pmod(F.xxhash64(u), F.lit(share)) == 0, F.concat(u, F.lit(_CUT))).otherwise(u))
    return F.split(F.array_join(marked, ""), f"(?<={_CUT})")


def _cut_long(pieces: Column, cut) -> Column:
    return F.flatten(F.transform(pieces, lambda p: F.when(F.char_length(p) <= LONGEST, F.array(p)).otherwise(cut(p))))


def passages(text: Column) -> Column:
    by_words = _cut_long(F.split(text, PASSAGE_END), lambda p: _cut(p, WORD_END, WORDS))
    return _cut_long(by_words, lambda p: _cut(p, "", CHARACTERS))


def _packed_sums() -> list[Column]:
    """Per segment: 16 sums of 4 packed small lanes, ``WIDE`` sums of 31-bit lanes, the total weight."""
    h = F.xxhash64(F.lit(0), F.col("piece"))
    weight = F.least(F.floor(F.sqrt(F.char_length("piece").cast("double"))), F.lit(HEAVIEST)).cast("long")
    bits = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES)) * weight).alias(f"b{k}") for k in range(16)]
    wide = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k + 1), F.col("piece")), 33)).alias(f"w{k}") for k in range(WIDE)]
    return [*bits, *wide, F.sum(weight).alias("n")]


def _lane_sums(when: Column | None = None, name: str = "") -> list[Column]:
    """Over segments: 32 sums of 2 lanes, ``WIDE`` sums modulo 2^31 kept apart, the total weight."""
    take = (lambda c: F.coalesce(F.sum(F.when(when, c)), F.lit(0))) if when is not None else F.sum
    low = [take(F.col(f"b{k}").bitwiseAND(F.lit(_PAIR))) for k in range(16)]
    high = [take(F.shiftrightunsigned(f"b{k}", 16).bitwiseAND(F.lit(_PAIR))) for k in range(16)]
    wide = [take(F.pmod(f"w{k}", F.lit(1 << 31))) for k in range(WIDE)]
    return [F.struct(F.array(*low, *high).alias("pair"), F.array(*wide).alias("wide"), take(F.col("n")).alias("n")).alias(name)]


def _lanes(v: Column) -> Column:
    """The 64 small lanes' sums."""
    pair = v["pair"]
    return F.concat(F.transform(pair, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))), F.transform(pair, lambda x: F.shiftrightunsigned(x, 32)))


def to_string(v: Column) -> Column:
    """Fixed-width hexadecimal form: 64 lanes modulo 2^16, then the wide lanes modulo 2^31."""
    part = lambda a, bits, width: F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << bits))), width, "0")))
    return F.lower(F.concat(part(_lanes(v), 16, 4), part(v["wide"], 31, 8)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated share of common passages (cosine of their counts); 1 if the fingerprints are equal."""
    signs = lambda v: F.transform(_lanes(v), lambda x: (F.lit(2) * x - v["n"]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = signs(a), signs(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
    return F.when(to_string(a) == to_string(b), 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(0.999999)))


def fingerprint(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` (unique per row) and ``fingerprint``, a struct that ``to_string``, ``likeness`` and ``combine`` read."""
    pieces = docs.select(*keys, F.posexplode(passages(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "piece"))
    seg = pieces.withColumn("fp_seg", F.shiftright("pos", SEGMENT_BITS)).groupBy(*keys, "fp_seg").agg(*_packed_sums())
    return seg.groupBy(*keys).agg(*_lane_sums(name="fingerprint"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after adding (sign 1) or deleting (sign -1) the passages of ``b``."""
    add = lambda f: F.zip_with(a[f], b[f], lambda x, y: x + F.lit(sign) * y)
    return F.struct(add("pair").alias("pair"), add("wide").alias("wide"), (a["n"] + F.lit(sign) * b["n"]).alias("n"))


def _bucket(spark, docs: DataFrame, id_col: str) -> Column:
    """Ranges of ids as bucket numbers that grow with the id; null ids are below all."""
    n = min(65_535, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / n for k in range(1, n)]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, max(10_000, 20 * n))).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    depth = max(1, len(cuts).bit_length())
    array = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    i = F.col(id_col).cast("long")

    found = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), F.lit(0), lambda lo, k: _search_step(array, len(cuts), depth, i, lo, k))
    return F.when(i.isNull(), -1).otherwise(found)


def _search_step(array: Column, n: int, depth: int, i: Column, lo: Column, k: Column) -> Column:
    to = lo + F.call_function("shiftleft", F.lit(1), F.lit(depth - 1) - k)
    return F.when((to <= n) & (F.get(array, to - 1) < i), to).otherwise(lo)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as much of the start of the next document in
    descending order of ids (after the last: the first).  Texts are dealt out once, by ranges of
    ids; to each range goes a copy of the next one's first document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _bucket(spark, docs, "doc_id").alias("bucket"))
    first = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))  # a row per range: 65,536 at most
    order = Window.orderBy(F.desc("bucket"))
    follows = first.select(
        "doc_id", F.col("bucket").alias("of"), F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to")
    )
    heads = rows.join(F.broadcast(follows), (F.col("bucket") == F.col("of")) & rows.doc_id.eqNullSafe(follows.doc_id)).select(rows.doc_id, "text", "to")
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("to").orderBy(F.desc(F.xxhash64("text")), F.desc("text")))).where("r = 1")
    both = rows.withColumn("extra", F.lit(0)).unionByName(heads.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("extra")))
    by_id = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc("text"))
    near = both.select("bucket", "extra", "doc_id", "text", F.lead("text").over(by_id).alias("follower"), F.row_number().over(by_id).alias("rid"))
    n = F.char_length("text")
    k = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.coalesce("follower", F.lit("")), F.lit(1), k))
    near = near.withColumn("edited", edited).withColumn("n_chars", n.cast("long")).withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["bucket", "rid", "extra", "doc_id", "n_chars", "sha"]
    kind = lambda k, t: F.struct(F.lit(k).alias("kind"), F.coalesce(t, F.lit("")).alias("t"))
    kinds = near.select(*keys, F.inline(F.array(kind(0, "text"), kind(1, "edited"))))
    pieces = kinds.select(*keys, "kind", F.posexplode(passages(F.col("t"))).alias("pos", "piece"))
    seg = pieces.withColumn("seg", F.shiftright("pos", SEGMENT_BITS)).drop("pos").groupBy(*keys, "kind", "seg").agg(*_packed_sums())
    both = seg.groupBy(*keys).agg(*_lane_sums(F.col("kind") == 0, "fp"), *_lane_sums(F.col("kind") == 1, "edited"))
    by_row = Window.partitionBy("bucket").orderBy("rid")
    out = both.withColumn("next", F.lead("fp").over(by_row)).where("extra = 0")
    return out.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        to_string(F.col("fp")).alias("fingerprint"),
        to_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next")).alias("near_next"),
    )
