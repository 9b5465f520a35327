"""The thin ``opN_`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import (
    decontaminate, fim, fingerprints, lang_id, mixing, repeats, secret_scan, set_join, sharding, token_counts, toxicity, whitening, wrappers,
)

TOKENIZER = "byte_bpe_50k.json"
TOKENIZER_FOLDER = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.document_languages(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_secrets(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.link_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZER_FOLDER}/{TOKENIZER}")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.document_fim(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.embedding_whitening(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP10 = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark
), windows AS (
  SELECT item, unnest(CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(0, greatest(len(w) - 9, 1)), lambda k: array_to_string(w[k + 1 : k + 10], ' ')) END) AS win,
    least(len(w), 10) AS size
  FROM items
), sizes AS (SELECT DISTINCT size FROM windows WHERE size > 0),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_ALNUM}, []) AS w FROM documents
), grams AS (
  SELECT r, size, unnest(range(0, len(w) - size + 1)) AS k, w FROM docs, sizes
), occ AS (
  SELECT DISTINCT r, item, k, g.size FROM grams g JOIN windows v
    ON v.size = g.size AND v.win = array_to_string(g.w[k + 1 : k + g.size], ' ')
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM occ) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


_OP4 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_AZ}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')))) END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s
), members AS (
  SELECT rep, len(s) AS n, unnest(s) AS shingle FROM classes
), pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM members x JOIN members y ON x.shingle = y.shingle AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT rep AS node, rep AS root FROM classes
  UNION SELECT b, root FROM reach JOIN links ON a = node
), least_root AS (
  SELECT node, min(root) AS component FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least_root ON node = rep
"""

_OP8 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), sized AS (
  SELECT *, CAST(octet_length(b) AS BIGINT) AS n FROM d
), starts AS (
  SELECT r, k, md5(b[k + 1 : k + {repeats.LENGTH}]) AS h FROM (SELECT r, b, unnest(range(0, n - {repeats.LENGTH - 1})) AS k FROM sized)
), again AS (
  SELECT r, k FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)
), fresh AS (
  SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + {repeats.LENGTH} THEN 0 ELSE 1 END AS begins FROM again
), runs AS (
  SELECT r, k, sum(begins) OVER (PARTITION BY r ORDER BY k) AS run FROM fresh
), spans AS (
  SELECT r, min(k) AS lo, max(k) + {repeats.LENGTH} AS hi FROM runs GROUP BY r, run
), removed AS (
  SELECT r, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM spans GROUP BY r
), pieces AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS z FROM spans
  UNION ALL SELECT r, coalesce(last, 0), n FROM sized LEFT JOIN removed USING (r)
), kept AS (
  SELECT r, string_agg(CASE WHEN a < z THEN hex(b[a + 1 : z]) ELSE '' END, '' ORDER BY a, z) AS k FROM pieces JOIN sized USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM sized JOIN kept USING (r) LEFT JOIN removed USING (r)
"""


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

_OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

_CRC_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"


def _crc_of_byte(c: str) -> str:
    """CRC-32 of a byte, bit by bit: the polynomial 0xEDB88320 = 3988292384 where the lowest bit is set."""
    return f"list_reduce(range(0, 8), lambda c, k: {_CRC_STEP}, {c})"


def _feistel(x: str) -> str:
    left, right = f"({x} % a)", f"({x} // a)"
    h = lambda v, m: f"(CAST('0x' || md5('{sharding.SEED}:' || k || ':' || {v})[1:12] AS BIGINT) % {m})"
    return f"CASE WHEN k % 2 = 0 THEN ({left} + {h(right, 'a')}) % a + a * {right} ELSE {left} + a * (({right} + {h(left, 'b')}) % b) END"


def _pass(x: str) -> str:
    return f"list_reduce(range(0, {sharding.ROUNDS}), lambda x, k: {_feistel('x')}, {x})"


_OP13 = f"""
WITH RECURSIVE bytes AS (SELECT list({_crc_of_byte('b')} ORDER BY b) AS crcs FROM range(0, 256) r(b)),
d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
    xor(4294967295, list_reduce(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '),
      lambda c, byte: CASE WHEN byte = '' THEN c ELSE xor(c >> 8, crcs[xor(c & 255, CAST('0x' || byte AS BIGINT)) + 1]) END, 4294967295)) AS text_crc32
  FROM (SELECT doc_id, text FROM documents) AS documents, bytes
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32 || ':'
      || CAST(doc_id IS NULL AS INT) || ':0:0')) - 1 AS r FROM d
), halves AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM documents)
), walk AS (
  SELECT r, n, a, b, {_pass('r')} AS x FROM numbered, halves
  UNION ALL SELECT r, n, a, b, {_pass('x')} FROM walk WHERE x >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 40 AS INTEGER) AS shard, x // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (r) WHERE x < n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": _OP4, "op8_repeats": _OP8, "op10_decontaminate": _OP10, "op11_fill_in_middle": _OP11, "op13_sharding": _OP13}
