"""op11 to op13 against brute force, and their defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import fim, sharding, whitening

DOCS = "doc_id long, text string, lang string, n long, form string, row string, shard string, place string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts() -> list[str | None]:
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéñ漢😀") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    gaps = [" ", "  ", "\n", "\t\r\n", "\x0b", "\x0c "]
    out = ["".join(rng.choice(gaps) + rng.choice(vocab) for _ in range(n)) + rng.choice(["", " ", "\n\n"]) for n in [1, 2, 5, 40, 300, 900, 2500] * 6]
    out += [None, "", " ", " \n\t ", "word", "a<P>b c", "x <S> y", "<M>", "a < P > b <", "<S", "é", "😀 😀", "   x"]
    shared = "".join(rng.choice(gaps) + rng.choice(vocab) for _ in range(4000))
    out += [shared, "x" + shared, shared[17:] + " tail", " " * 40_000, "w" * 40_000, "漢" * 20_000, "ab " * 30_000]
    return out + [out[3]] * 5


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", 7, "mine", "r", "s", "p") for i, t in enumerate(texts())] + [(None, "some words here", "en", 0, "", "", "", ""), (3, "again three", "fr", 0, "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fim_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_digests(rows, docs, empty):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(tuple(r) for r in fim.document_fim(docs).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        n, form, p, m, out = fim_by_hand(doc_id, text)
        want[(doc_id, n, form, p, m, sha(out), sha(text or ""))] += 1
    assert got == want
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fim.document_fim(empty).count() == 0


def test_fim_outputs_and_round_trip(rows, docs):
    """The operator's real output, carried columns, and the text rebuilt from output and form."""
    made = fim.transformed(docs, fim_percent=100, spm_percent=40)
    assert made.columns == ["doc_id", "text", "lang", "row", "shard", "place", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.select(F.coalesce("text", F.lit("")).alias("text"), "form", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(back) == len(rows) and all(r.back == r.text for r in back)
    assert sum(r.form != "plain" for r in back) > 40
    assert all(len(r.output) == len(r.text) + 9 for r in back if r.form != "plain")


def test_fim_units_by_chunks():
    """Every unit's end, from chunk summaries, equals the end found by matching the whole text."""
    known = fim.Summaries()
    for text in texts():
        data = (text or "").encode()
        raw = np.frombuffer(data, np.uint8)
        ends = fim.chunk_ends(raw, fim.rolling_cuts(raw))
        assert (ends or [0])[-1] == len(data) and all(b - a <= fim.MOST for a, b in zip([0, *ends], ends, strict=False))
        units = fim.Units(data, ends, known)
        want = [0, *np.cumsum([len(u) for u in UNIT.findall(text or "")]).tolist()]
        assert units.n == len(want) - 1
        step = max(1, len(want) // 50)
        assert [units.end(k) for k in range(0, len(want), step)] == want[::step]
    assert known.hits > 10  # chunks of passages that texts share are summarised once


def test_fim_rolling_cuts_follow_content(monkeypatch):
    raw = np.random.default_rng(1).integers(32, 127, 60_000).astype(np.uint8)
    whole = fim.rolling_cuts(raw)
    assert len(whole) > 20
    shifted = fim.rolling_cuts(np.concatenate([raw[:777], raw]))
    assert set(whole[whole > fim.REACH] + 777) <= set(shifted)
    monkeypatch.setattr(fim, "SEGMENT", 1000)  # segments change nothing
    assert (fim.rolling_cuts(raw) == whole).all()


def test_fim_cache_is_bounded():
    known = fim.Summaries(limit=10_000)
    for k in range(1000):
        known.get(f"{k:0300d}".encode())
    assert known.held < 11_000
    assert known.get(b" a b") == (4, 1, True, True)


def test_fim_long_text(spark):
    """3 MB in one text: cut where matching the whole text cuts it."""
    text = "one two  three\n" * 200_000
    arr = pa.array([text])
    out = fim.cut_points(arr, pa.array([123_456]), pa.array([399_999]), fim.Summaries()).to_pylist()[0]
    units = UNIT.findall(text)
    assert out["n"] == len(units) == 600_001
    i, j = sorted((123_456 % 600_002, 399_999 % 600_002))
    assert (out["prefix_chars"], out["middle_chars"]) == (sum(map(len, units[:i])), sum(map(len, units[i:j])))


# --- sharding -------------------------------------------------------------------


def by_hand_pass(x, n, back=False):
    a, b = sharding.halves(n)
    left, right = x % a, x // a
    h = lambda k, v, m: int(hashlib.md5(f"42:{k}:{v}".encode()).hexdigest()[:12], 16) % m
    rounds = range(sharding.ROUNDS)
    for k in reversed(rounds) if back else rounds:
        sign = -1 if back else 1
        if k % 2 == 0:
            left = (left + sign * h(k, right, a)) % a
        else:
            right = (right + sign * h(k, left, b)) % b
    return left + a * right


def by_hand_place(x, n):
    x = by_hand_pass(x, n)
    steps = 0
    while x >= n:
        x, steps = by_hand_pass(x, n), steps + 1
    return x, steps


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 101, 1000, 2503])
def test_place_is_a_permutation(spark, n):
    a, b = sharding.halves(n)
    assert n <= a * b < n + a
    want = [by_hand_place(x, n) for x in range(n)]
    steps = sharding.walk_steps(spark, n)
    assert steps == max(s for _, s in want)
    at = spark.range(n).select("id", sharding.place(F.col("id"), n, steps).alias("p"))
    got = at.select("id", "p", sharding.place(F.col("p"), n, steps, back=True).alias("back")).orderBy("id").collect()
    assert [r.p for r in got] == [p for p, _ in want]
    assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)


def test_document_shards(spark, rows, docs, empty):
    got = sharding.document_shards(docs).collect()
    assert len(got) == len(rows)
    data = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == data
    per = Counter(r.shard for r in got)
    assert set(per) <= set(range(40)) and max(per.values()) - min(per.get(s, 0) for s in range(40)) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.document_shards(empty).count() == 0
    again = sharding.document_shards(docs.repartition(3, "text")).collect()  # another layout, the same shards
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_sharded_carries_columns_and_numbers_copies(spark):
    """One row a third of all: copies take consecutive numbers over all tasks that hold them."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("old").alias("row"), F.col("id").alias("mine"), F.lit(1).alias("slot")).repartition(7)
    out = sharding.sharded(df, ["doc_id"], shards=7)
    assert out.columns == ["doc_id", "mine", "row", "place", "shard", "slot"]
    got = out.collect()
    assert sorted(r.row for r in got) == list(range(3000)) and sorted(r.mine for r in got) == list(range(3000))
    hot = sorted(r.row for r in got if r.doc_id == 0)
    assert hot == list(range(hot[0], hot[0] + 1000))
    steps = sharding.walk_steps(spark, 3000)
    back = out.select("row", sharding.row_at(F.col("shard"), F.col("slot"), 3000, steps, shards=7).alias("at")).collect()
    assert all(r.row == r.at for r in back)


# --- whitening --------------------------------------------------------------------


VECTORS = "vec_id long, embedding array<float>, n string, deviation string"


def vectors(count=400, dims=12, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((count, dims)) * np.linspace(0.2, 0.05, dims)
    return np.float32(base @ np.linalg.qr(rng.standard_normal((dims, dims)))[0])


def frame(spark, lists, parts=4):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(lists)], VECTORS).repartition(parts)


def brute(data):
    x = np.floor(1024 * data.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    off = x - s / n
    values, turn = np.linalg.eigh(off.T @ off / n)
    k = min(8, x.shape[1])
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, s, strict=True)) for row in x]
    return off @ turn / np.sqrt(values), values / np.trace(off.T @ off / n), deviation


def test_whitening_against_eigh(spark):
    data = vectors()
    lists = [list(map(float, v)) for v in data]
    odd = [None, [], [None] * 12, [1.0] * 11 + [float("nan")], [1.0] * 11 + [float("inf")], [0.5] * 7]
    got = whitening.embedding_whitening(frame(spark, lists + odd)).toPandas()
    want, share, deviation = brute(data)
    assert len(got) == 400 * 8 and set(got.n) == {400}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(400)].to_numpy()
    sign = np.sign(np.sum(wide * want, axis=0))
    assert np.abs(wide * sign - want).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), share, rtol=1e-12)
    assert got[got.component == 3].set_index("vec_id").deviation.loc[range(400)].tolist() == deviation
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_degenerate_tables(spark):
    one = [[0.25, -0.5, 1.0]]
    assert whitening.embedding_whitening(frame(spark, one)).count() == 0  # no variance
    assert whitening.embedding_whitening(frame(spark, one * 9)).count() == 0
    assert whitening.embedding_whitening(frame(spark, [None, [None]])).count() == 0
    assert whitening.embedding_whitening(spark.createDataFrame([], VECTORS)).count() == 0
    flat = [[float(k), 3.0, 5.0] for k in range(10)] * 2  # one direction varies; every vector comes twice
    got = whitening.embedding_whitening(frame(spark, flat)).toPandas()
    assert set(got.component) == {1} and len(got) == 20 and got.explained.iloc[0] == pytest.approx(1)
    assert np.abs(got.whitened).max() == pytest.approx(4.5 / np.sqrt(8.25))


def test_whitening_repeats_and_lengths(spark):
    data = vectors(60, 9, 3)
    lists = [list(map(float, v)) for v in data] + [list(map(float, data[0]))] * 30 + [[1.0, 2.0]] * 20
    got = whitening.embedding_whitening(frame(spark, lists)).toPandas()
    want, _, deviation = brute(np.vstack([data, np.repeat(data[:1], 30, axis=0)]))
    assert got.vec_id.nunique() == 90 and len(got) == 720
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-8
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == deviation


@pytest.mark.parametrize("kind", ["wide", "equal", "few"])
def test_jacobi_davidson(kind):
    """Wider than the search space; equal leading eigenvalues; fewer nonzero eigenvalues than wanted."""
    rng = np.random.default_rng(2)
    dims = 220
    turn, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    values = np.sort(rng.random(dims) ** 3)[::-1] * 50
    if kind == "equal":
        values[:4] = 50
    if kind == "few":
        values[3:] = 0
    matrix = (turn * values) @ turn.T
    got, vectors_, residual = whitening.jacobi_davidson(lambda v: matrix @ v, dims, 8)
    assert np.abs(got - values[:8]).max() < 1e-10 and residual < 1e-10
    assert np.abs(vectors_.T @ vectors_ - np.eye(8)).max() < 1e-12


def test_minres_meets_the_correction_equation():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    q = np.linalg.qr(rng.standard_normal((40, 3)))[0]
    off = np.eye(40) - q @ q.T
    right = (off @ rng.standard_normal(40))[:, None]
    t = whitening._minres(lambda v: a @ v, np.array([0.3]), right, [q], 80)
    assert np.linalg.norm(off @ (a - 0.3 * np.eye(40)) @ off @ t - right) < 1e-6 * np.linalg.norm(right)


def test_sums_do_not_wrap():
    with pytest.raises(OverflowError):
        whitening._checked_sums(np.array([[1 << 50]]))
    x = np.array([[100_000, 3], [0, 7]])
    n = 10**9
    sums = [50_000 * n, 5 * n]
    with pytest.raises((OverflowError, pa.ArrowInvalid)):
        whitening._deviations(x, n, sums)
