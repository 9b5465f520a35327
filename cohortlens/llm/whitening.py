"""Embedding whitening: principal directions by a distributed Jacobi-Davidson method.

The covariance of the vectors is never formed.  What the method needs of it are its
products with a few directions at a time, and each is one pass over the data:
every task centres its vectors, multiplies them with the directions and back, and
returns one small sum; sums are added up by a grouped aggregate in ``MERGERS`` groups,
so the driver gets ``MERGERS`` small blocks whatever the number of tasks.

Jacobi-Davidson: within the search space, Rayleigh-Ritz gives approximate
eigenvalues and eigenvectors.  For each wanted one that has not converged, the
correction equation (I - QQ')(V - eI)(I - QQ') t = -r, with Q the locked vectors and the
approximation itself, is solved roughly by some steps of MINRES; all equations go in
step, so a step is one pass for all of them.  The corrections widen the search
space, which is restarted from its best vectors when it is full.  A vector whose
residual is at most ``PRECISION`` times the largest eigenvalue, with all before it, is
locked; the loop ends when all are.

``fitted`` returns the directions and sums as a small model that other tables can be
whitened with (``whitened``).

Sums are exact: entries become whole numbers x, per-dimension sums S and sums of
squares are added as whole numbers, and ``deviation`` is computed as whole numbers.

Defined cases: rows whose vector is null, empty, holds a null or a non-finite entry, or
has another length than most vectors (ties: the longer) are left out; null ids are kept;
repeated rows and repeated ids each count and each get their rows; equal eigenvalues
get any orthonormal directions; directions of no variance (an eigenvalue of at most
1e-9 of the trace: fewer vectors than components, constant entries) can't be
whitened and are left out; an empty table, or one of equal vectors, gives no rows; extra
columns are not carried; a result too large for a long raises instead of wrapping around.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARD = 4  # further directions in the search space from the start
BLOCK_BYTES = 1 << 20
MERGERS = 16
INNER = 6  # steps of MINRES for a correction
WIDEST = 10  # search space at most so many times the components
OUTER = 100
PRECISION = 1e-13
NO_VARIANCE = 1e-9

Matrix = np.ndarray


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the usable rows, their entries as whole numbers."""
    c = F.col("v")
    ok = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(ok, F.lit(False)))
    whole = F.transform("v", lambda e: F.floor(F.lit(float(SCALE)) * e).cast("long") + F.lit(SHIFT))
    return usable.select("id", whole.alias("x"))


def blocks(rows: DataFrame) -> DataFrame:
    """Vectors of one length packed into blocks of about ``BLOCK_BYTES``, written once: (dims, ids, data)."""
    schema = f"dims int, ids array<{rows.schema['id'].dataType.simpleString()}>, data binary"

    def pack(batches):
        for batch in batches:
            ids, x = batch.column(0), batch.column(1)
            sizes = np.diff(np.asarray(x.offsets))
            flat = np.asarray(x.flatten(), np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                data = flat[starts[at][:, None] + np.arange(d)]
                step = max(1, BLOCK_BYTES // (8 * int(d)))
                for lo in range(0, len(at), step):
                    got = ids.take(pa.array(at[lo : lo + step]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d], pa.int32()),
                            pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), got),
                            pa.array([data[lo : lo + step].tobytes()], pa.binary()),
                        ],
                        names=["dims", "ids", "data"],
                    )

    return written(rows.mapInArrow(pack, schema), "vectors")


def _usual_length(packed: DataFrame) -> int:
    sizes = packed.groupBy("dims").agg(F.sum(F.size("ids")).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()  # a row per length
    return top[0].dims if top else 0


def _matrix(data: pa.Scalar, dims: int) -> Matrix:
    return np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims)


def summed(packed: DataFrame, of: Callable[[Matrix], Matrix], size: int, kind: str = "double") -> Matrix:
    """Sum over all blocks of ``of(block)``, flat arrays of ``size`` numbers: one per task, then ``MERGERS``, then one.

    Each sum takes its parts in the order of the tasks, so it comes out the same every time."""
    schema = f"task int, total array<{kind}>"
    number = np.float64 if kind == "double" else np.int64
    arrow = pa.from_numpy_dtype(number)

    def added(rows, task: int):
        total = np.zeros(size, number)
        for r in rows:
            total += r
        flat = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(total, arrow))
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), flat], names=["task", "total"])

    def per_task(batches):
        task, parts = None, np.zeros(size, number)
        for batch in batches:
            for k in range(len(batch)):
                task = batch.column(0)[k].as_py()
                parts += of(_matrix(batch.column(2)[k], batch.column(1)[k].as_py()))
        if task is not None:
            yield added([parts], task)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        rows = (np.asarray(table.column("total")[k].values) for k in range(table.num_rows))
        return pa.Table.from_batches([added(rows, table.column("task")[0].as_py())])

    partial = packed.select(F.spark_partition_id().alias("task"), "dims", "data").mapInArrow(per_task, schema)
    merged = partial.groupBy(F.pmod("task", F.lit(MERGERS))).applyInArrow(merge, schema)
    total = np.zeros(size, number)
    for row in sorted(merged.collect()):  # MERGERS rows at most
        total += np.array(row.total, number)
    return total


@dataclass
class Whitening:
    """A fitted whitening: count, exact sums, trace, and eigenpairs by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: Matrix
    vectors: Matrix  # a column per component
    passes: int = 0
    residual: float = 0.0

    @property
    def mean(self) -> Matrix:
        return np.array([s / self.n for s in self.sums])  # whole numbers divided once


def _minres(product, shifts: Matrix, right: Matrix, spaces: list[Matrix], steps: int) -> Matrix:
    """Some steps of MINRES for (I - QQ')(V - shift)(I - QQ') t = right, a column each, all in step."""

    def off(y: Matrix) -> Matrix:
        for j, q in enumerate(spaces):
            for _ in range(2):
                y[:, j] -= q @ (q.T @ y[:, j])
        return y

    v = off(right.copy())
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = v / np.where(live, beta, 1)
    before, t = np.zeros_like(v), np.zeros_like(v)
    w0, w1 = np.zeros_like(v), np.zeros_like(v)
    eta, start = beta.copy(), beta.copy()
    c0 = c1 = np.ones(len(beta))
    s0 = s1 = np.zeros(len(beta))
    lanczos = np.zeros(len(beta))
    for _ in range(steps):
        y = off(product(v) - v * shifts)
        alpha = np.sum(v * y, axis=0)
        y = off(y - v * alpha - before * lanczos)
        after = np.linalg.norm(y, axis=0)
        # Two old rotations on the new column of the tridiagonal matrix, then a new one.
        delta = c1 * alpha - c0 * s1 * lanczos
        rho1 = np.hypot(delta, after)
        rho2 = s1 * alpha + c0 * c1 * lanczos
        rho3 = s0 * lanczos
        ok = live & (rho1 > 0)
        safe = np.where(ok, rho1, 1)
        c0, s0, c1, s1 = c1, s1, np.where(ok, delta / safe, 1), np.where(ok, after / safe, 0)
        w0, w1 = w1, np.where(ok, (v - w0 * rho3 - w1 * rho2) / safe, 0)
        t = t + w1 * (c1 * eta)
        eta = -s1 * eta
        live = ok & (after > 1e-14 * np.abs(start)) & (np.abs(eta) > 1e-9 * start)
        if not live.any():
            break
        before, v = v, np.where(live, y / np.where(after > 0, after, 1), 0)
        lanczos = np.where(live, after, 0)
        eta = np.where(live, eta, 0)
    return off(t)


def _orthonormal(new: Matrix, base: Matrix) -> Matrix:
    """Columns of ``new`` made orthonormal to ``base`` and each other; dependent ones go."""
    kept = base
    for k in range(new.shape[1]):
        y = new[:, k]
        size = np.linalg.norm(y)
        if not size > 0:
            continue
        y = y / size
        for _ in range(3):
            y = y - kept @ (kept.T @ y)
        left = np.linalg.norm(y)
        if left > 1e-10:
            y = y / left
            y = y - kept @ (kept.T @ y)
            kept = np.column_stack([kept, y / np.linalg.norm(y)])
    return kept[:, base.shape[1] :]


def jacobi_davidson(product: Callable[[Matrix], Matrix], dims: int, wanted: int, seed: int = 0) -> tuple[Matrix, Matrix, float]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, their eigenvectors and the largest residual."""
    wanted = min(wanted, dims)
    start = np.random.default_rng(seed).standard_normal((dims, min(dims, wanted + GUARD)))
    space = _orthonormal(start, np.zeros((dims, 0)))
    image = product(space)
    locked, locked_image = np.zeros((dims, 0)), np.zeros((dims, 0))
    best, idle = np.inf, 0
    for _ in range(OUTER):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        turn = turn[:, ::-1]
        values, ritz, ritz_image = values[::-1], space @ turn, image @ turn
        left = wanted - locked.shape[1]
        residuals = ritz_image[:, :left] - ritz[:, :left] * values[:left]
        residuals = residuals - locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        top = max([abs(values[0]) if len(values) else 0.0, *np.abs(np.sum(locked * locked_image, axis=0))])
        # What rounding in the products leaves can't be mended: after steps without gain it counts as converged below 1e-11.
        idle = idle + 1 if sizes.max(initial=0) > best / 2 else 0
        best = min(best, sizes.max(initial=0))
        bound = (PRECISION if idle < 3 else 1e-11) * top
        done = 0
        while done < min(left, len(values)) and sizes[done] <= bound:
            done += 1
        full = space.shape[1] + locked.shape[1] >= dims  # the space is everything: Ritz pairs are exact to rounding
        if done == left or (full and idle >= 3):
            vectors = np.column_stack([locked, ritz[:, :left]])
            images = np.column_stack([locked_image, ritz_image[:, :left]])
            h = vectors.T @ images
            values, turn = np.linalg.eigh((h + h.T) / 2)
            values, vectors, images = values[::-1], vectors @ turn[:, ::-1], images @ turn[:, ::-1]
            return values, vectors, float(np.linalg.norm(images - vectors * values, axis=0).max(initial=0))
        locked = np.column_stack([locked, ritz[:, :done]])
        locked_image = np.column_stack([locked_image, ritz_image[:, :done]])
        # Restart from the best vectors when the space is full, else go on in Ritz form.
        keep = ritz.shape[1] if ritz.shape[1] + left - 2 * done <= WIDEST * wanted else left + GUARD
        space, image = ritz[:, done:keep], ritz_image[:, done:keep]
        values, residuals = values[done:left], residuals[:, done:]
        spaces = [np.column_stack([locked, space[:, j]]) for j in range(residuals.shape[1])]
        t = _minres(product, values, -residuals, spaces, INNER)
        new = _orthonormal(t, np.column_stack([locked, space]))
        if new.shape[1] == 0:  # no correction adds anything: widen by chance
            chance = np.random.default_rng(seed + locked.shape[1] + 1).standard_normal((dims, 1))
            new = _orthonormal(chance, np.column_stack([locked, space]))
        if new.shape[1]:
            image_new = product(new)
            space, image = np.column_stack([space, new]), np.column_stack([image, image_new])
    raise RuntimeError(f"no convergence in {OUTER} steps: residual {best}")


def fitted(packed: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit a whitening to the vectors in ``packed`` (see ``blocks``) of the usual length."""
    dims = _usual_length(packed)
    if not dims:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    packed = packed.where(F.col("dims") == dims)
    totals = summed(packed, lambda x: np.concatenate(([len(x)], _checked_sums(x))), 1 + dims, "long")
    model = Whitening(int(totals[0]), [int(s) for s in totals[1:]], 0.0, np.zeros(0), np.zeros((dims, 0)))
    mean = model.mean

    def product(v: Matrix) -> Matrix:
        model.passes += 1
        shape = v.shape

        def of(x: Matrix) -> Matrix:
            y = x - mean
            return (y.T @ (y @ v)).ravel()

        return summed(packed, of, v.size).reshape(shape) / model.n

    model.trace = float(summed(packed, lambda x: np.array([np.sum((x - mean) ** 2)]), 1)[0] / model.n)
    if model.trace > 0:
        values, vectors, model.residual = jacobi_davidson(product, dims, components)
        ok = values > NO_VARIANCE * model.trace
        model.values, model.vectors = values[ok], vectors[:, ok]
    return model


def _checked_sums(x: Matrix) -> Matrix:
    """Per-dimension sums; raises where a block's entries are too large for exact sums of many blocks."""
    if len(x) and np.abs(x).max() >= 1 << 40:
        raise OverflowError("vector entries beyond 2^30 can't be summed exactly")
    return x.sum(axis=0)


def _deviations(x: Matrix, n: int, sums: list[int]) -> pa.Array:
    """sum over dimensions of (n * x - S)^2, exact; raises if it is beyond a long."""
    s = np.array(sums, object)
    most = max((max(abs(n * int(a) - t), abs(n * int(b) - t)) for a, b, t in zip(x.min(axis=0), x.max(axis=0), sums, strict=True)), default=0)
    if most * most * len(sums) < 1 << 63 and n * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 63:
        off = n * x - s.astype(np.int64)
        return pa.array(np.sum(off * off, axis=1))
    return pa.array([sum((n * int(a) - t) ** 2 for a, t in zip(row, sums, strict=True)) for row in x], pa.int64())


def identity_error(packed: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by one pass over them."""
    k, mean, turn = len(model.values), model.mean, model.vectors / np.sqrt(model.values)

    def of(x: Matrix) -> Matrix:
        w = (x - mean) @ turn
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    total = summed(packed, of, k + k * k) / model.n
    first, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max())


def whitened(packed: DataFrame, model: Whitening) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    id_type = packed.schema["ids"].dataType.elementType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k, dims = len(model.values), len(model.sums)
    packed = packed.where(F.col("dims") == dims) if k else packed.limit(0)
    error = identity_error(packed, model) if k else 0.0
    n, sums, mean = model.n, model.sums, model.mean if k else None
    turn = model.vectors / np.sqrt(model.values) if k else None
    share = model.values / model.trace if k else None

    def out(batches):
        for batch in batches:
            for b in range(len(batch)):
                x = _matrix(batch.column(1)[b], dims)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[b].values.take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n)),
                        _deviations(x, n, sums).take(pa.array(each)),
                        pa.array(((x - mean) @ turn).ravel()),
                        pa.array(np.tile(share, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return packed.select("ids", "data").mapInArrow(out, schema)


def embedding_whitening(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fit to all usable vectors of ``rows`` (vec_id, embedding) and whiten them."""
    packed = blocks(whole_vectors(rows))
    return whitened(packed, fitted(packed, components))
