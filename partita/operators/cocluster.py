"""Co-clustering of rows and columns by a projective factorisation X ~ W W' X H H'.

``entries`` has unit_id, attr_id, x; W is (unit_id, w) and H (attr_id, h) with arrays of r and c doubles. Iterations keep
a unit's entries packed beside its row of W; H goes to the tasks as centres do in k-means (up to ``CELLS`` numbers), and
X'W comes back as sums. So a round is one pass, and the objective follows from matrices that are at hand by then. Wider
factors are joined: products with X are then sums through r or c columns.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.operators.encode import Dataset
from partita.sources.scratch import Tables, written

TINY = float(np.finfo(float).eps)
#: Numbers of a factor over the attributes that go to every task: 128 MB.
CELLS = 1 << 24
#: Rounds of subspace iteration at most, and the change of the singular values at which it ends.
ITERATIONS = 1000
SETTLED = 1e-9
ROWS = 4096
#: Rounds of a fit after which the rows of W are written.
WRITTEN = 10


def entries_of(data: Dataset) -> DataFrame:
    return data.ones.select("unit_id", "attr_id", F.lit(1.0).alias("x"))


def _width(df: DataFrame, column: str) -> int:
    row = df.select(F.size(column).alias("n")).first()
    return row.n if row else 0


def project(entries: DataFrame, factors: DataFrame, over: str, column: str, by: str, name: str) -> DataFrame:
    """X times H (over attr_id, by unit_id) or X' times W (over unit_id, by attr_id)."""
    r = _width(factors, column)
    sums = entries.join(factors, over).groupBy(by).agg(*[F.sum(F.col("x") * F.col(column)[k]).alias(f"s{k}") for k in range(r)])
    return sums.select(by, F.array(*[F.col(f"s{k}") for k in range(r)]).alias(name))


def gram(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over rows of the outer products of two array columns."""
    r, c = _width(rows, left), _width(rows, right)
    if not r or not c:
        return np.zeros((r, c))
    sums = rows.agg(*[F.coalesce(F.sum(F.col(left)[a] * F.col(right)[b]), F.lit(0.0)).alias(f"g{a}_{b}") for a in range(r) for b in range(c)]).first()
    return np.array([[sums[f"g{a}_{b}"] for b in range(c)] for a in range(r)])


def _filled(df: DataFrame, rows: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """``df`` with the products in ``rows``, zeros where X has no entry."""
    return df.join(rows, key, "left").withColumn(column, F.coalesce(column, F.array(*[F.lit(0.0)] * width)))


def objective(entries: DataFrame, w: DataFrame, h: DataFrame) -> float:
    """Squared distance of X from its projection, by small matrices only."""
    c = _width(h, "h")
    xh = _filled(w, project(entries, h, "attr_id", "h", "unit_id", "xh"), "unit_id", "xh", c)
    total = entries.agg(F.sum(F.col("x") * F.col("x")).alias("t")).first().t or 0.0
    return _value(total, gram(xh, "w", "xh"), gram(w, "w", "w"), gram(h, "h", "h"))


def _value(total: float, wxh: np.ndarray, ww: np.ndarray, hh: np.ndarray) -> float:
    return float(total - 2 * (wxh**2).sum() + np.trace(hh @ wxh.T @ ww @ wxh))


def _times(column: str, matrix: np.ndarray) -> list[Column]:
    """A row vector times a small matrix, as one expression for each column of it."""
    return [sum((F.col(column)[a] * float(matrix[a, b]) for a in range(matrix.shape[0])), F.lit(0.0)) for b in range(matrix.shape[1])]


def _updated(rows: DataFrame, key: str, column: str, product: str, up: np.ndarray, own: np.ndarray, other: np.ndarray) -> DataFrame:
    above, below, more = _times(product, 2 * up), _times(column, own), _times(product, other)
    new = [F.col(column)[k] * F.pow(above[k] / (below[k] + more[k] + TINY), 0.25) for k in range(len(above))]
    return rows.select(key, F.array(*new).alias(column))


class _Packed:
    """Some packed units: entries as arrays, and rows of W."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("at")
        self.flat, self.x = lists.flatten().to_numpy(), batch.column("x").flatten().to_numpy()
        self.lengths = pc.list_value_length(lists).to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.row = np.repeat(np.arange(batch.num_rows), self.lengths)
        self.w = batch.column("w").flatten().to_numpy().reshape(batch.num_rows, -1)

    def times(self, h: np.ndarray) -> np.ndarray:
        """X H of these units."""
        out = np.zeros((len(self.lengths), h.shape[1]))
        some = self.lengths > 0
        if some.any():
            out[some] = np.add.reduceat(self.x[:, None] * h[self.flat], self.starts[some], axis=0)
        return out

    def back(self, w: np.ndarray, m: int) -> np.ndarray:
        """X' W of these units."""
        return np.stack([np.bincount(self.flat, self.x * w[self.row, k], minlength=m) for k in range(w.shape[1])], 1)


def _pack(entries: DataFrame, rows: DataFrame, ids: np.ndarray) -> DataFrame:
    """unit_id, w, at (places of attributes among ``ids``) and x of the units in ``rows``; others and unknown attributes
    have no part in a product."""
    known = entries.sparkSession.createDataFrame([(int(a), k) for k, a in enumerate(ids)], f"attr_id {dict(entries.dtypes)['attr_id']}, at int")
    placed = entries.join(F.broadcast(known), "attr_id").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x")))).alias("e"))
    empty = F.expr("cast(array() as array<struct<at: int, x: double>>)")
    joined = rows.join(placed, "unit_id", "left").select("unit_id", "w", F.coalesce("e", empty).alias("e"))
    return joined.select("unit_id", "w", F.col("e.at").alias("at"), F.col("e.x").alias("x"))


def _driver(factor: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the matrix of a factor over the attributes, of at most ``CELLS`` numbers."""
    rows = sorted(factor.select("attr_id", column).collect(), key=lambda r: r.attr_id)
    return np.array([r.attr_id for r in rows], np.int64), np.array([r[column] for r in rows], float).reshape(len(rows), -1)


def _gathered(sums: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A matrix from the sums (at, v: one row of it) of all tasks."""
    width = shape[1]
    rows = sums.groupBy("at").agg(*[F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(width)]).toArrow()
    out = np.zeros(shape)
    if rows.num_rows:
        out[rows.column("at").to_numpy()] = np.stack([rows.column(f"s{k}").to_numpy() for k in range(width)], 1)
    return out


def _rows_of(matrix: np.ndarray) -> tuple[pa.Array, pa.Array]:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.array(np.arange(len(matrix), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def _multiplied(factor: np.ndarray, product: np.ndarray, up: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return factor * ((product @ (2 * up)) / (factor @ own + product @ other + TINY)) ** 0.25


def fit(entries: DataFrame, w: DataFrame, h: DataFrame, *, max_iter: int = 1000, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame, list[float]]:
    """W, H and the objective after each round of multiplicative updates, until its relative change is small.

    A round is one pass over the units, from which the sums X'W and W'W come back. Rows of W are written every
    ``WRITTEN`` rounds; between, a pass repeats the updates since then, which costs less than writing all units.
    """
    r, c = _width(w, "w"), _width(h, "h")
    if not r or not c or h.count() * max(r, c) > CELLS:
        return _fit_joined(entries, w, h, max_iter, tolerance)
    total, spark = entries.agg(F.sum(F.col("x") * F.col("x")).alias("t")).first().t or 0.0, entries.sparkSession
    ids, hm = _driver(h, "h")
    m, tables, kind = len(ids), Tables(), dict(w.dtypes)["unit_id"]
    rows = tables.written(_pack(entries, w, ids))
    updates: list[tuple[np.ndarray, tuple[np.ndarray, ...]]] = []

    def parts(batches: Iterator[pa.RecordBatch], since: list) -> Iterator[tuple[pa.RecordBatch, _Packed, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                units = _Packed(batch := whole.slice(at, ROWS))
                new = units.w
                for factor, update in since:
                    new = _multiplied(new, units.times(factor), *update)
                yield batch, units, new

    def summed() -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(list(updates))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((m + r, r))
            for _, units, new in parts(batches, shared.value):
                sums[:m] += units.back(new, m)
                sums[m:] += new.T @ new
            yield pa.RecordBatch.from_arrays(list(_rows_of(sums)), ["at", "v"])

        both = _gathered(rows.mapInArrow(run, "at int, v array<double>"), (m + r, r))
        return both[:m], both[m:]

    def updated() -> DataFrame:
        shared = spark.sparkContext.broadcast(list(updates))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, new in parts(batches, shared.value):
                yield pa.RecordBatch.from_arrays([batch.column("unit_id"), _rows_of(new)[1], batch.column("at"), batch.column("x")], ["unit_id", "w", "at", "x"])

        return tables.written(rows.mapInArrow(run, f"unit_id {kind}, w array<double>, at array<int>, x array<double>"))

    xw, ww = summed()
    values = [_value(total, xw.T @ hm, ww, hm.T @ hm)]
    for _ in range(max_iter):
        wxh, hh = xw.T @ hm, hm.T @ hm
        updates.append((hm, (wxh.T, wxh @ hh @ wxh.T, hh @ wxh.T @ ww)))
        if len(updates) == WRITTEN:
            rows = updated()
            updates = []
        xw, ww = summed()
        wxh = xw.T @ hm
        hm = _multiplied(hm, xw, wxh, wxh.T @ ww @ wxh, ww @ wxh @ hh)
        values.append(_value(total, xw.T @ hm, ww, hm.T @ hm))
        if abs(values[-1] - values[-2]) < tolerance * abs(values[-2]):
            break
    final = written(updated().select("unit_id", "w"))
    tables.drop()
    return final, spark.createDataFrame([(int(i), row) for i, row in zip(ids, hm.tolist())], f"attr_id {dict(h.dtypes)['attr_id']}, h array<double>"), values


def _fit_joined(entries: DataFrame, w: DataFrame, h: DataFrame, max_iter: int, tolerance: float) -> tuple[DataFrame, DataFrame, list[float]]:
    """The same for factors that are too wide for the tasks: every product is a join."""
    r, c, tables = _width(w, "w"), _width(h, "h"), Tables(keep=6)
    total = entries.agg(F.sum(F.col("x") * F.col("x")).alias("t")).first().t or 0.0
    values = [objective(entries, w, h)]
    for _ in range(max_iter):
        w = tables.written(_filled(w, project(entries, h, "attr_id", "h", "unit_id", "xh"), "unit_id", "xh", c))
        wxh, ww, hh = gram(w, "w", "xh"), gram(w, "w", "w"), gram(h, "h", "h")
        w = tables.written(_updated(w, "unit_id", "w", "xh", wxh.T, wxh @ hh @ wxh.T, hh @ wxh.T @ ww))
        h = tables.written(_filled(h, project(entries, w, "unit_id", "w", "attr_id", "xw"), "attr_id", "xw", r))
        wxh, ww = gram(h, "xw", "h"), gram(w, "w", "w")
        new = tables.written(_updated(h, "attr_id", "h", "xw", wxh, wxh.T @ ww @ wxh, ww @ wxh @ hh))
        values.append(_value(total, gram(h.drop("h").join(new, "attr_id"), "xw", "h"), ww, gram(new, "h", "h")))
        h = new
        if abs(values[-1] - values[-2]) < tolerance * abs(values[-2]):
            break
    return w, h, values


def assign_argmax(factors: DataFrame, key: str, column: str) -> DataFrame:
    """Cluster (from 1) of each row: the place of its largest factor, the first of equals."""
    return factors.select(key, F.array_position(column, F.array_max(column)).cast("int").alias("cluster"))


def discretise(vectors: DataFrame, key: str, column: str, *, max_iter: int = 1000) -> DataFrame:
    """Indicators (key, column) of the rotation that brings normalised rows nearest to one-of-c vectors."""
    c = _width(vectors, column)
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v * v))
    y = written(vectors.select(key, F.transform(column, lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("y")))
    rotation = np.zeros((c, c))
    rotation[:, 0] = y.orderBy(key).limit(1).first().y
    seen = F.lit(0.0)
    for k in range(1, c):
        seen = seen + F.abs(_times("y", rotation[:, k - 1 : k])[0])
        rotation[:, k] = y.orderBy(F.round(seen, 12), key).limit(1).first().y
    old, chosen = 0.0, y
    for _ in range(max_iter):
        turned = F.array(*_times("y", rotation))
        chosen = y.select(key, "y", turned.alias("t")).select(key, "y", F.array_position("t", F.array_max("t")).alias("at"))
        hot = chosen.select(key, "y", F.transform(F.sequence(F.lit(1), F.lit(c)), lambda k: (k == F.col("at")).cast("double")).alias("z"))
        u, d, vt = np.linalg.svd(gram(hot, "z", "y"))
        if abs(d.sum() - old) < TINY:
            break
        old, rotation = d.sum(), vt.T @ u.T
    return chosen.select(key, F.transform(F.sequence(F.lit(1), F.lit(c)), lambda k: (k == F.col("at")).cast("double")).alias(column))


def svd_init(data: Dataset, row_clusters: int, column_clusters: int) -> tuple[DataFrame, DataFrame]:
    """W and H to start from: discretised leading singular vectors of the ones."""
    right, sigma = leading_directions(data, max(row_clusters, column_clusters))
    scaled = right.withColumn("h", F.array(*[F.col("h")[k] / float(sigma[k]) for k in range(row_clusters)]))
    u = _filled(data.units.select("unit_id"), project(entries_of(data), F.broadcast(scaled), "attr_id", "h", "unit_id", "w"), "unit_id", "w", row_clusters)
    return discretise(u, "unit_id", "w"), discretise(right.withColumn("h", F.slice("h", 1, column_clusters)), "attr_id", "h")


def leading_directions(data: Dataset, most: int) -> tuple[DataFrame, np.ndarray]:
    """Right singular vectors (attr_id, h) and singular values of the ones, the largest first.

    Subspace iteration: X'X is applied to ``most`` + 8 vectors in one pass over the units and the result made
    orthonormal, until the values settle. As many numbers as attributes times vectors go to the tasks and come back; they
    must be ``CELLS`` at most. A warning says so if ``ITERATIONS`` end before the values have settled.
    """
    ids = np.array(sorted(r.attr_id for r in data.attributes.select("attr_id").collect()), np.int64)
    m, spark = len(ids), data.ones.sparkSession
    width = min(most + 8, m)
    if m * width > CELLS:
        raise ValueError(f"{width} vectors of {m} attributes are more than the {CELLS} numbers that go to tasks")
    empty = data.units.select("unit_id", F.expr("cast(array() as array<double>)").alias("w"))
    rows = written(_pack(entries_of(data), empty, ids).select("at", "x", "w"))

    def applied(h: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(h)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shared.value.shape)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    units = _Packed(whole.slice(at, ROWS))
                    sums += units.back(units.times(shared.value), m)
            yield pa.RecordBatch.from_arrays(list(_rows_of(sums)), ["at", "v"])

        return _gathered(rows.mapInArrow(run, "at int, v array<double>"), h.shape)

    h = np.linalg.qr(np.random.default_rng(17).normal(size=(m, width)))[0]
    old, settled = np.zeros(width), m == 0
    for _ in range(ITERATIONS if m else 0):
        product = applied(h)
        squares, turn = np.linalg.eigh(h.T @ product)
        sigma = np.sqrt(np.maximum(squares[::-1], 0.0))
        if np.abs(sigma - old)[:most].max() <= SETTLED * max(sigma[0], TINY):
            h, settled = h @ turn[:, ::-1], True
            break
        old = sigma
        h = np.linalg.qr(product @ turn[:, ::-1])[0]
    if not settled:
        warnings.warn(f"singular values still change after {ITERATIONS} rounds", stacklevel=2)
    full, values = np.zeros((m, most)), np.full(most, 1e-6)
    n = min(most, width)
    full[:, :n] = h[:, :n] * np.where(h[:, :n].sum(0) < 0, -1, 1)
    values[:n] = np.maximum(sigma[:n], 1e-6) if m else values[:n]
    kind = dict(data.attributes.dtypes)["attr_id"]
    return spark.createDataFrame([(int(a), row) for a, row in zip(ids, full.tolist())], f"attr_id {kind}, h array<double>"), values
