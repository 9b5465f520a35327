"""A bit table of ids: one fixed size whatever their number, no false negatives.

It only spares rows a shuffle; a join on the ids themselves always follows, so
a full table costs time, never results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.text import mix

BITS = 25


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(slots: np.ndarray) -> tuple[bool, bytes]:
    """Distinct slots as (whole, bytes): the table's bits, or the slots themselves where that is shorter."""
    if len(slots) * 32 < 1 << BITS:
        return False, slots.astype(np.uint32).tobytes()
    table = np.zeros(1 << BITS, bool)
    table[slots] = True
    return True, np.packbits(table).tobytes()


def unpacked(whole: bool, data) -> np.ndarray:
    """The distinct slots of ``packed``."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) if whole else np.frombuffer(data, np.uint32).astype(np.int64)


def bit_table(ids: DataFrame) -> np.ndarray:
    """Table of the first column of ``ids`` (long, not null): tasks' tables are united in a task, so
    the driver gets one, and of a few ids no more than their slots."""

    def united(slots):
        table = np.zeros(1 << BITS, bool)
        for some in slots:
            table[some] = True
        whole, data = packed(np.flatnonzero(table))
        return pa.RecordBatch.from_arrays([pa.array([whole]), pa.array([data], pa.binary())], names=["whole", "data"])

    def bits(batches):
        yield united(_slot(batch.column(0).to_numpy(zero_copy_only=False)) for batch in batches)

    def unite(batches):
        yield united(unpacked(w.as_py(), d.as_buffer()) for batch in batches for w, d in zip(batch.column(0), batch.column(1), strict=True))

    kind = "whole boolean, data binary"
    table = np.zeros((1 << BITS) // 8, np.uint8)
    for row in ids.coalesce(16).mapInArrow(bits, kind).repartition(1).mapInArrow(unite, kind).collect():
        if row.whole:
            table |= np.frombuffer(row.data, np.uint8)
        else:
            slots = unpacked(False, row.data)
            np.bitwise_or.at(table, slots >> 3, (128 >> (slots & 7)).astype(np.uint8))
    return table


def member(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slot(ids)
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
