"""Embedding whitening by a bidiagonal qd solver.

1. Entries become whole numbers, and their sums per dimension are exact, so rows are centred by whole numbers too.
2. Every task folds its centred rows block by block into a triangular factor (QR), and factors are merged in groups of
   ``FAN`` until one is left. It has as many rows as there are dimensions, whatever the number of vectors.
3. On the driver that one factor is made bidiagonal by Householder reflections; the differential quotient-difference
   algorithm with shifts (dqds) finds the squares of its singular values to high relative accuracy, and twisted
   factorisations, all values abreast, give the directions.
4. Rows are projected by Spark. How far the result is from white is summed over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import materialise, slices

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
#: Entries beyond this (after scaling) count as this, so that they stay whole numbers that a double can hold.
LARGEST = 2.0**52
BLOCK = 4096
FAN = 32
#: Singular values below this share of the largest are none: the direction has no spread.
LEAST_SHARE = 1e-10
#: Squares that differ relatively by less are one cluster, whose directions are found together.
CLOSE = 1e-7
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of U' R V for Householder reflections U and V, and V."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        length = np.linalg.norm(x)
        if length == 0 or not np.any(x[1:]):
            return None
        u = x / length
        u[0] += 1.0 if u[0] >= 0 else -1.0
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        u = reflector(a[k, k + 1 :]) if k + 2 < d else None
        if u is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One dqds transform: new q and e, the least d, and the place of the first d below zero (the length if none is)."""
    d, least, new_q, new_e = q[0] - shift, q[0] - shift, [], []
    if d < 0:
        return q, e, d, 0
    for i, x in enumerate(e):
        top = d + x
        t = q[i + 1] / top if top > 0 else 1.0
        new_q.append(top)
        new_e.append(x * t)
        d = d * t - shift
        least = min(least, d)
        if not d >= 0:  # also for what is no number
            return q, e, d, i + 1
    return [*new_q, d], new_e, least, len(q)


def squares(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of a bidiagonal matrix, from the squares of its diagonals, the largest first."""
    small, out, todo = (4 * EPS) ** 2, [], [(list(q), list(e), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        least = 0.0
        for _ in range(100 * (len(q) + 1)):
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (sigma + min(q[i], q[i + 1])) or e[i] <= TINY), None)
            if cut is not None and cut < len(e) - 1:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e, least = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if cut is not None:
                out.append(sigma + q.pop())
                e.pop()
                least = 0.0 if not q else min(least, q[-1])
                continue
            if len(q) == 1:
                break
            if len(q) == 2:
                gap = q[0] - q[1] + e[0]
                high = (q[0] + q[1] + e[0] + np.sqrt(gap * gap + 4 * q[1] * e[0])) / 2
                out.append(float(sigma + high))
                q, e = [float(q[0] * (q[1] / high))], []
                break
            if least == 0.0 and q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = least
            for tries in range(8):
                new_q, new_e, d, at = _step(q, e, shift)
                if at == len(q):
                    break
                # The last d alone below zero makes shift + d a lower bound; else the shift was far too large.
                shift = shift + d if at == len(q) - 1 and 0 < shift + d < shift else shift / 4
                shift = 0.0 if tries == 6 else shift
            q, e, least, sigma = new_q, new_e, d, sigma + shift
        out += [sigma + x for x in q]
    return sorted(out, reverse=True)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of a bidiagonal matrix (diagonals a and b) for the squares of its singular values.

    For all values at once: B'B - value is factorised from the top and from the bottom, both are joined where the pivot
    is least, and the vector follows from there in both directions.
    """
    d, m = len(a), len(values)
    square, off, product = a * a, b * b, a[:-1] * b
    safe = lambda x: np.where(x == 0, TINY, x)
    s, p = np.empty((d, m)), np.empty((d, m))
    down, up = np.zeros((max(d - 1, 0), m)), np.zeros((max(d - 1, 0), m))
    s[0], p[-1] = -values, square[-1] - values
    for i in range(d - 1):
        top = safe(square[i] + s[i])
        down[i], s[i + 1] = product[i] / top, off[i] / top * s[i] - values
    for i in range(d - 2, -1, -1):
        low = safe(off[i] + p[i + 1])
        up[i], p[i] = product[i] / low, square[i] / low * p[i + 1] - values
    twist = np.abs(s + p + values).argmin(0)
    z = np.zeros((d, m))
    z[twist, np.arange(m)] = 1.0
    for i in range(d - 2, -1, -1):
        z[i] = np.where(i < twist, -down[i] * z[i + 1], z[i])
    for i in range(d - 1):
        z[i + 1] = np.where(i >= twist, -up[i] * z[i], z[i + 1])
    z /= np.maximum(np.linalg.norm(z, axis=0), TINY)
    return _apart(z, a, b, values)


def _apart(z: np.ndarray, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors of values that are nearly equal, made orthogonal: their common space by inverse iteration."""
    at, m = 0, len(values)
    while at < m:
        end = at + 1
        while end < m and values[end - 1] - values[end] <= CLOSE * values[end - 1]:
            end += 1
        if end - at > 1:
            middle = np.diag(a) + np.diag(b, 1)
            t = middle.T @ middle
            space = z[:, at:end] + np.random.default_rng(at).normal(size=(len(a), end - at)) * 0.1
            for _ in range(4):
                space = np.linalg.qr(np.linalg.solve(t - (values[at] * (1 + 8 * EPS) + EPS * EPS * values[0]) * np.eye(len(a)), space))[0]
            _, turn = np.linalg.eigh(space.T @ t @ space)
            z[:, at:end] = space @ turn[:, ::-1]
        at = end
    return z


@dataclass
class Whitening:
    """What rows are projected with: number of rows, centre (a whole number and a rest over n for each dimension),
    directions over root of eigenvalue, eigenvalues and their sum over all dimensions."""

    n: int
    whole: np.ndarray
    rest: list[int]
    weights: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) ** 2, exact; null beyond 64 bits."""
        off = x - self.whole
        if not x.size:
            return [0] * len(x)
        if (self.n * (int(np.abs(off).max()) + 1)) ** 2 * x.shape[1] < 2**63:
            return ((self.n * off - np.array(self.rest)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in off]
        return [v if v < 2**63 else None for v in exact]


def whole_entries(vectors: DataFrame) -> DataFrame:
    """vec_id and x: entries as whole numbers, of rows whose vector is not null and holds finite entries only."""
    values = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform("v", lambda e: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), e * SCALE))) + OFFSET)
    return values.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for batch in slices(batches, BLOCK):
        x = _matrix(batch)
        high, low = (x >> 26).sum(0), (x & (2**26 - 1)).sum(0)
        some = [int(h) * 2**26 + int(w) for h, w in zip(high, low)]
        total = [s + t for s, t in zip(total, some)] if total else some
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total], pa.string())], ["at", "s"])


def _merged(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def _triangle(rows: DataFrame, centre: Whitening, dimension: int) -> np.ndarray:
    """The triangular factor of all centred rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = None, 0
        for batch in slices(batches, BLOCK):
            r, part = _merged(r, centre.centred(_matrix(batch))), batch.column("part")[0].as_py()
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for packed in table.column("r").to_pylist():
            r = _merged(r, np.frombuffer(packed).reshape(-1, dimension))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    left = rows.rdd.getNumPartitions()
    factors = rows.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(fold, "part long, r binary")
    while True:
        factors = factors.select((F.col("part") / FAN).cast("long").alias("part"), "r").groupBy("part").applyInArrow(merge, "part long, r binary")
        left = -(-left // FAN)
        if left <= 1:
            break
    r = np.frombuffer(factors.first().r).reshape(-1, dimension)
    return np.concatenate([r, np.zeros((dimension - len(r), dimension))])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (vec_id, x); None if there is no row or no dimension.

    ``components`` and the number of dimensions bound what comes to the driver: one triangular factor.
    """
    sums = sorted(rows.mapInArrow(_sums, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    n, dimension = rows.count(), len(sums)
    if not n or not dimension:
        return None
    total = [int(s.s) for s in sums]
    whole = [(2 * s + n) // (2 * n) for s in total]
    none = np.zeros((dimension, 0))
    centre = Whitening(n, np.array(whole, np.int64), [s - n * w for s, w in zip(total, whole)], none, np.zeros(0), 0.0)
    r = _triangle(rows, centre, dimension)
    scale = float(np.abs(r).max()) or 1.0
    a, b, v = bidiagonal(r / scale)
    values = np.array(squares((a * a).tolist(), (b * b).tolist()))
    known = values[: min(components, int((values > LEAST_SHARE**2 * values[0]).sum()) if values[0] > 0 else 0)]
    centre.trace = float(((r / scale) ** 2).sum()) * scale**2 / n
    if len(known):
        # All values of a cluster take part, also those after the last component.
        more = int((values > known[-1] * (1 - 2 * CLOSE)).sum())
        vectors = v @ directions(a, b, values[:more])[:, : len(known)]
        centre.eigenvalues = known * scale**2 / n
        centre.weights = vectors / np.sqrt(centre.eigenvalues)
    return centre


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity."""
    k = model.weights.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in slices(batches, BLOCK):
            w = model.centred(_matrix(batch)) @ model.weights
            total += np.concatenate([w.T @ w, w.sum(0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    summed = sorted(rows.mapInArrow(products, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect())
    total = np.array([r.v for r in summed]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component.

    Rows stay one to one, those with equal or null ids too. Left out are rows whose vector is null or holds null or
    non-finite entries, and, where vectors are of several lengths, those of another length than most (of equally common
    lengths the largest counts). Components along which rows do not differ cannot be whitened and are left out: one
    row, or equal rows only, give no rows, nor does an empty table. ``deviation`` is null beyond 64 bits.
    """
    clean = materialise(whole_entries(vectors))
    usual = clean.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).first()
    rows = clean.where(F.size("x") == (usual["size"] if usual else 0))
    model = fit(rows, components)
    k = model.weights.shape[1] if model else 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), schema)
    error = _identity_error(rows, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, BLOCK):
            x = _matrix(batch)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            each = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(row), pa.array((each + 1).astype(np.int32)), pa.array(np.full(len(each), m.n)),
                pa.array(m.deviations(x), pa.int64()).take(row), pa.array((m.centred(x) @ m.weights).ravel()),
                pa.array((m.eigenvalues / m.trace)[each]), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
