"""The secret scan's lexer: base spans against the plain expressions, constants, very long texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import secret_scan

BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """The contract's base spans by the plain expressions."""
    out = []
    for k, (kind, (pattern, keep)) in enumerate(BASE.items()):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text, flags) if keep(m)]
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


def texts(n: int = 400) -> list[str]:
    rng = random.Random(11)
    parts = ["password", "Token", "api_key", "apikey", "API_KEY", "ſecret", "=", ":", " ", '"', "'", "\n", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "x9/+=", "secret", ".", "é", "&", "auth", "+", "(", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_base_spans_equal_the_plain_expressions(spark):
    rows = [*enumerate(texts()), (1000, None), (1001, "")]
    got = {r.doc_id: r for r in secret_scan.document_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert sum(r.n_assign > 0 for r in got.values()) > 20
    for i, text in rows:
        want = base_spans(text or "")
        line = ",".join(f"{kind}:{a}:{b}" for a, kind, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for _, k, _ in want) for kind in BASE)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("named:")] == [s for s in line.split(",") if s]


def test_whole_test_table_against_the_plain_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.base_sha256 for r in secret_scan.document_secrets(docs).collect()}
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        line = ",".join(f"{kind}:{a}:{b}" for a, kind, b in base_spans(r.text))
        assert got[r.doc_id] == hashlib.sha256(line.encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "secrets"),
    [
        ('a="Zk39fjQ0"\nb=a+"2mVb81Lx"\ncfg.secret_key=b\n', ["Zk39fjQ0", "2mVb81Lx"]),
        ('auth_key: str = "Zk39fjQ02mVb"', ["Zk39fjQ02mVb"]),
        ('a = auth_key = "Zk39fjQ02mVb81"', ["Zk39fjQ02mVb81"]),
        ("url=https://x.y/z?auth_sig=Zk39fjQ02mVb&private_key=Zk39fjQ02mVc x", ["Zk39fjQ02mVb", "Zk39fjQ02mVc"]),
        ("auth_key=Zk39fjQ02mVb= ", ["Zk39fjQ02mVb="]),
        ("run --auth-key=Zk39fjQ02mVb81 now", ["Zk39fjQ02mVb81"]),
        ('a="Zk39fjQ02mVb"\na2=a+a\nauth_key=a2+a2', ["Zk39fjQ02mVb"]),
        ("auth_key=<put-Your2Key3here>", []),
        ("note = Zk39fjQ02mVb81", []),
    ],
)
def test_names_values_and_constants(text, secrets):
    assert [text[a:b] for kind, a, b, _ in secret_scan.scan(text) if kind == "named"] == secrets


N = 1_000_000


@pytest.mark.parametrize(
    "text",
    [
        "key=" + "a" * N, "x" * N + " key=Zk39fjQ02mVb81", "a=key=" * (N // 6), 'key="' * (N // 5), 'key="' + "<" * N + '"', "key " + " " * N + "=x",
        "&key=Zk39fjQ02mVb81" * (N // 19), "token=Zk39fjQ02mVb81 auth_key=Zk39fjQ02mVb82\n" * (N // 46),
    ],
)
def test_long_texts_take_about_linear_time(text):
    short = text[: N // 8]
    took = []
    for t in (short, text):
        at = time.process_time()
        secret_scan.scan(t)
        took.append(time.process_time() - at)
    assert took[1] < 12 * 2 * max(took[0], 0.05)
