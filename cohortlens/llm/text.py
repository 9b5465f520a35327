"""Vectorised helpers over Arrow string columns: whole texts, no row-at-a-time loops.

A text column arrives in a task as Arrow record batches.  ``chunks`` cuts a
batch into runs of rows whose bytes stay under a memory bound (a longer single
text is a run of its own), ``words`` finds and hashes every word of a run at
numpy speed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls read as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


@dataclass
class Run:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and offsets relative to them."""

    lo: int
    hi: int
    raw: np.ndarray
    off: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Run]:
    raw, off = string_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Run(lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def byte_table(word_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(word_bytes)] = True
    return table


#: Everything but white space (0x20, 0x09-0x0D).
NON_SPACE = byte_table(b for b in range(256) if b not in (0x20, 9, 10, 11, 12, 13))
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = byte_table(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < max(n, 1):
        size = max(n, CHUNK_BYTES + 1024)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Words:
    """Words of a run in order: byte spans, hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray  # len rows + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running sum of byte * B^i modulo 2^64, with a leading zero."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up, out=out[1:])
    return out


def words(run: Run, table: np.ndarray = NON_SPACE, lower: bool = True) -> Words:
    raw, off = (LOWER_AZ[run.raw] if lower else run.raw), run.off
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    pre = prefix_hash(raw)
    _, down = powers(len(raw) + 1)
    h = mix((pre[end] - pre[start]) * down[start] + (end - start).astype(_U))
    row = np.searchsorted(off, start, side="right") - 1
    first = np.searchsorted(start, off)
    return Words(start, end, h, row, first)


def hash_words(items: list[str], lower: bool = True) -> np.ndarray:
    """The hash ``words`` gives each of these strings as a whole word."""
    out = np.zeros(len(items), _U)
    for run in chunks(pa.array(items, pa.large_string())):
        raw = LOWER_AZ[run.raw] if lower else run.raw
        pre, (_, down) = prefix_hash(raw), powers(len(raw) + 1)
        a, b = run.off[:-1], run.off[1:]
        out[run.lo : run.hi] = mix((pre[b] - pre[a]) * down[a] + (b - a).astype(_U))
    return out


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (order matters); len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True at the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
