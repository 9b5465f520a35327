"""Secret scan with an assignment-aware lexer.

Three base patterns find assignments to sensitive names, access keys and long
hexadecimal strings.  Beyond them, a lexer reads source and configuration
syntax (``name = "literal"``, ``"name": "literal"``, ``name: literal``,
``export NAME=literal``, ``name := literal``) into name-literal pairs, joins
literals and known names added with ``+``, and propagates constants: in ``a = "..."``
and then ``password = a`` the literal of ``a`` belongs to ``password`` too, in
``a = b = "..."`` and ``a: str = "..."`` the literal belongs to both names.  An unquoted value ends at a blank, a
quote, a bracket or the next name that takes a value by ``=`` (``?auth=x&key=y``); a
constant counts once in a value, however often it is added.  A literal is
scored by the sensitivity of its target names and by how much it looks like a
random string; those over ``THRESHOLD`` are added as kind ``named`` unless a base
span covers them.

Defined cases: null and empty texts have no spans; an empty table gives no rows;
spans are in code points, end exclusive; spans that start at one place are ordered
by kind as listed, then by end; repeated rows each get their own spans; further
columns stay, and one named like an output column is replaced.  Every text is read
whole, in time about linear in its length: names are tried at their first character
only, and every stretch of an unquoted value is read once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.shared import bounded_batches

KINDS = ("assign", "access", "hex", "named")
THRESHOLD = 0.5
#: Weights of name parts that make a target sensitive.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "key": 0.6,
}
PLACEHOLDER = re.compile(r"(?i)change|example|placeholder|dummy|sample|your[-_ ]?|xxx|\*\*\*|todo|none|null|true|false")
TEMPLATES = (("<", ">"), ("${", "}"), ("{{", "}}"))

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME_HINT = re.compile(r"pass|pwd|secret|token|key|credential|auth|bearer|signature")
_NAME = r"""(["']?)(?<![A-Za-z0-9_.\-])[0-9.\-]*+([A-Za-z_][A-Za-z0-9_.\-]*+)\1"""
_TARGET = re.compile(_NAME + r"[ \t]*+(?:=>|:=|=(?![=>])|:(?![:/]))[ \t]*+")
_CHAIN = re.compile(_NAME + r"""(?:[ \t]++(?:=>|:=|=(?![=>]))|(?:=>|:=|=(?![=>]))(?=[^\s,;#)}\]>]))""")
_INNER = re.compile(_NAME + r"""(?:=>|:=|=(?![=>]))(?=[^\s"'`,;#(){}\[\]<>])""")
_LITERAL = re.compile(r"""\"((?:[^"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`""")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+(?![(\[./=-])")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>]++""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def sensitivity(name: str) -> float:
    """0 to 1: the largest weight of a part, or of two parts together, of a name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: how much a literal looks like a generated secret."""
    if len(literal) < 8 or " " in literal or PLACEHOLDER.search(literal) or any(0 <= literal.find(a) < literal.rfind(b) for a, b in TEMPLATES):
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(f(ch) for ch in literal) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, entropy / 4.0) * (0.3, 0.4, 0.85, 1.0)[classes]


def pairs(text: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """Name-literal pairs of a text in order, constants propagated: (name, value, spans of its literals)."""
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    out = []
    names: list[str] = []  # targets of the next value
    at = run = 0  # ``run``: end of the unquoted run that was read last
    while m := _TARGET.search(text, at):
        names.append(m[2])
        pos, value, spans, at = m.end(), "", [], m.end()
        if _CHAIN.match(text, pos):  # a further target, or the type of this one: the value follows it
            continue
        while True:
            if lit := _LITERAL.match(text, pos):
                g = lit.lastindex or 1
                value, pos = value + lit[g], lit.end()
                spans = [*spans, lit.span(g)]
                at = pos
            elif (ref := _IDENT.match(text, pos)) and ref[0] in known:
                more, pos = known[ref[0]], ref.end()
                if not {*more[1]}.intersection(spans):
                    value, spans = value + more[0], [*spans, *more[1]]
            elif not spans and (pos < run or (bare := _BARE.match(text, pos))):
                run = run if pos < run else bare.end()
                inner = _INNER.search(text, pos, run + 1)
                at = inner.start() if inner and inner.end() <= run else run
                cut = at - (pos < at < run and text[at - 1] in "&?|")
                value, spans = text[pos:cut], [(pos, cut)] * (cut > pos)
                break
            else:
                break
            if not (plus := _PLUS.match(text, pos)):
                break
            pos = plus.end()
        for name in names if spans else ():
            known[name] = (value, spans)
            out.append((name, value, spans))
        names = []
    return out


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text: (kind, start, end, score), by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    if ("=" in text or ":" in text) and _NAME_HINT.search(low):
        base = sorted((a, b) for _, a, b, _ in found)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        named: dict[tuple[int, int], float] = {}
        strengths: dict[str, float] = {}
        for name, value, spans in pairs(text):
            if weight := sensitivity(name):
                if value not in strengths:
                    strengths[value] = strength(value)
                score = round(weight * strengths[value], 6)
                for a, b in spans:
                    before = bisect_left(starts, b)
                    if score >= THRESHOLD and not (before and reach[before - 1] > a):
                        named[a, b] = max(score, named.get((a, b), 0.0))
        found += [("named", a, b, s) for (a, b), s in named.items() if b > a]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def with_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", redacted: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with an array of (kind, start, end, score) per text; an equally named column is replaced.

    With ``redacted``, also a column of that name: the text with every span replaced by ``mask``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out_col, *([redacted] if redacted else []))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            spans, masked = [], []
            for v in batch.column(batch.schema.get_field_index(text_col)):
                s = v.as_py()
                got = scan(s or "")
                spans.append([{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in got])
                if redacted:
                    masked.append(s if s is None else redact(s, got, mask))
            more = [pa.array(spans, kind), *([pa.array(masked, pa.string())] if redacted else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, out_col, *([redacted] if redacted else [])])

    element = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField(out_col, T.ArrayType(element)), *([T.StructField(redacted, T.StringType())] if redacted else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def redact(text: str, spans: list[tuple[str, int, int, float]], mask: str) -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def document_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named."""
    rows = with_secrets(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    line = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return rows.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(F.filter("secrets", lambda s: s["kind"] != "named")).cast("binary"), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
        of("named").alias("n_named"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text masked, columns unchanged; no document goes."""
    rows = with_secrets(docs, text_col, "sc_spans", redacted="sc_text")
    return rows.select(*(F.col("sc_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
