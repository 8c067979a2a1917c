"""Approximate nearest neighbours by learned partitions.

1. On the driver, from a sample of at most ``SAMPLE`` vectors (the smallest hashes of their ids): the graph of nearest
   neighbours is cut into balanced parts by recursive bisection (a spectral split at the median, then exchanges of the
   best pairs), and a small network is trained to tell a vector's part.
2. Every row is indexed under its likeliest part. Parts of more than ``LARGEST`` rows are split again, each in a task of
   its own and from a sample of its own, so that parts stay small when the table grows. A part is dealt into blocks of about ``BLOCK`` rows by hash, so
   that neither a popular part nor a vector that a third of the rows share lands in one task. Repeated rows count once.
3. A query goes to its likeliest parts, to all their blocks, and is compared there in double precision. Of equal
   vectors a block keeps the few smallest ids only, which are all that can be among the nearest.

How many parts are probed is measured: the fewest that find ``RECALL`` of the true neighbours in the sample for
vectors the network was not trained on, and never so few that they might hold less than k rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import hash60, materialise

SAMPLE = 8192
BLOCK = 4096
RECALL = 0.97
#: Parts of a router at most; larger tables get routers below the first.
MAX_PARTS = 256
#: Rows of a part from which it has parts of its own.
LARGEST = 1 << 16
DEGREE = 10
HIDDEN = 64
QUERIES_AT_ONCE = 512


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by cosine, in blocks."""
    out = np.empty((len(x), k), int)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(edges: np.ndarray, n: int, share: float, rng: np.random.Generator) -> np.ndarray:
    """True for the ``share`` of n nodes on one side of a small cut; edges: pairs of nodes, both ways."""
    a, b = edges
    degree = np.maximum(1, np.bincount(a, minlength=n)).astype(float)
    v, size = rng.normal(size=n), max(1, min(n - 1, round(share * n)))
    for _ in range(60):  # towards the second eigenvector of the random walk
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], minlength=n) / degree
        v /= max(1e-12, np.abs(v).max())
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[:size]] = True
    for _ in range(20):  # exchange the nodes that gain most, as many on either side
        inside = np.bincount(a, side[b], minlength=n)
        gain = np.where(side, degree - 2 * inside, 2 * inside - degree)
        ins, outs = np.flatnonzero(side), np.flatnonzero(~side)
        ins, outs = ins[np.argsort(-gain[ins], kind="stable")], outs[np.argsort(-gain[outs], kind="stable")]
        m = min(len(ins), len(outs))
        good = int(((gain[ins[:m]] + gain[outs[:m]]) > 0).sum() * 0.5)
        if good == 0:
            break
        side[ins[:good]], side[outs[:good]] = False, True
    return side


def partition(neighbours: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """Balanced parts of a neighbour graph: for each node a number below ``parts``."""
    n, rng, out = len(neighbours), np.random.default_rng(seed), np.zeros(len(neighbours), int)
    a, b = np.repeat(np.arange(n), neighbours.shape[1]), neighbours.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, base, p = todo.pop()
        out[nodes] = base
        if p > 1 and len(nodes) > 1:
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            own = (place[a] >= 0) & (place[b] >= 0)
            side = bisect((place[a[own]], place[b[own]]), len(nodes), (p // 2) / p, rng)
            todo += [(nodes[side], base, p // 2), (nodes[~side], base + p // 2, p - p // 2)]
    return out


class Router:
    """A network with one hidden layer that ranks the parts of a vector."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(max(1, x.shape[1])), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(30 if parts > 1 else 0):
            for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                h = np.maximum(0, x[some] @ self.w[0] * 4 + self.w[1])
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), y[some]] -= 1
                p /= len(some)
                back = (p @ self.w[2].T) * (h > 0)
                grads = [4 * x[some].T @ back, back.sum(0), h.T @ p, p.sum(0)]
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w[0] * 4 + self.w[1]) @ self.w[2] + self.w[3]


class Index:
    """Router, number of parts, parts to probe for the wanted recall in the sample, and the dimension."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        x = _scaled(sample)
        x = x / np.sqrt((x**2).sum(1, keepdims=True))
        x = np.unique(x, axis=0)  # a vector that many rows share counts once
        self.dimension = sample.shape[1]
        self.parts = max(1, min(MAX_PARTS, int(np.sqrt(rows) / 4), len(x) // 16))
        if self.parts == 1:
            self.router, self.probes = Router(x, np.zeros(len(x), int), 1), 1
            return
        x = x[np.random.default_rng(3).permutation(len(x))]
        train = x[: max(1, len(x) * 3 // 4)]
        labels = partition(_nearest(train, min(DEGREE, len(train) - 1)), self.parts)
        self.router = Router(train, labels, self.parts)
        self.probes = self._probes(x, x[len(train) :][:500], min(k, len(x) - 1))

    def _probes(self, x: np.ndarray, queries: np.ndarray, k: int) -> int:
        homes, ranked = self.router.scores(x).argmax(1), np.argsort(-self.router.scores(queries), axis=1, kind="stable")
        s = queries @ x.T
        s[s > 1 - 1e-12] = -np.inf
        true = np.argpartition(-s, k - 1, axis=1)[:, :k]
        places = np.argsort(ranked, axis=1)[np.arange(len(queries))[:, None], homes[true]]
        found = [(places < p).mean() for p in range(1, self.parts + 1)]
        return next(p for p, r in enumerate(found, 1) if r >= RECALL or p == self.parts)


def usable(embedding: Column) -> Column:
    """True for vectors that are not null, not zero, and hold finite components only."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay the same, bit by bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0.0))[1])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def build(vectors: DataFrame, *, k: int = 5, sample: int = SAMPLE) -> tuple[Index | None, DataFrame]:
    """The index and its rows: vec_id, v (the components as 64-bit floats), part, and probed parts in order.

    The sample has at most ``sample`` vectors; every usable row is indexed.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    clean = materialise(clean.distinct())  # a row that is repeated counts once
    rows = clean.count()
    drawn = clean.orderBy(hash60("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    if not drawn:
        return None, clean.select("vec_id", F.lit(None).cast("binary").alias("v"), F.lit(0).alias("part"), F.array(F.lit(0)).alias("probe"))
    lengths = pd.Series([len(r.embedding) for r in drawn])
    dimension = int(lengths.mode().iloc[0])
    index = Index(np.array([r.embedding for r in drawn if len(r.embedding) == dimension]), rows, k)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
            even = _scaled(x)
            unit = even / np.sqrt((even**2).sum(1, keepdims=True))
            scores = shared.value.router.scores(unit)
            ranked = np.argsort(-scores, axis=1, kind="stable").astype(np.int32)
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            probe = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * ranked.shape[1]), pa.array(ranked.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed, pa.array(ranked[:, 0]), probe], ["vec_id", "v", "part", "probe"])

    same = clean.where(F.size("embedding") == dimension)
    return index, same.mapInArrow(run, "vec_id long, v binary, part int, probe array<int>")


def _best(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    """The k nearest ids of a block for each query, by exact cosines; an id is as near as the nearest of its vectors."""
    (qid, q), (rid, r) = queries, rows
    order = np.argsort(rid, kind="stable")
    rid, r = rid[order], np.ascontiguousarray(r[order])
    # Of equal vectors, the k + 1 smallest ids: one may be the query's own.
    _, kind = np.unique(r.view(np.dtype((np.void, r.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(kind, kind="stable")
    start = np.concatenate([[True], np.diff(kind[by]) != 0])
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    keep = np.sort(by[rank <= k])
    rid, r, q = rid[keep], _scaled(r[keep]), _scaled(q)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(rid) != 0]))
    rn, qn = np.sqrt((r * r).sum(1)), np.sqrt((q * q).sum(1))
    found = []
    for a in range(0, len(q), QUERIES_AT_ONCE):
        s = (q[a : a + QUERIES_AT_ONCE] / qn[a : a + QUERIES_AT_ONCE, None]) @ (r / rn[:, None]).T
        s[qid[a : a + QUERIES_AT_ONCE, None] == rid[None, :]] = -np.inf
        each = np.maximum.reduceat(s, heads, axis=1)  # of an id's vectors, the nearest
        least = np.partition(each, max(0, each.shape[1] - k), axis=1)[:, max(0, each.shape[1] - k)]
        at, of = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
        exact = (q[a + at] * r[of]).sum(1) / (qn[a + at] * rn[of])
        found.append(pd.DataFrame({"query_id": qid[a + at], "vec_id": rid[of], "score": exact}))
    every = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    return every[every.groupby("query_id").cumcount() < k]


def _below(rows: DataFrame, queries: DataFrame, large: dict[int, int], probes: int, k: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v, leaf) of all rows, and of the queries a row for each leaf they go to.

    A leaf is a part, or a part of a large part. A large part's router is fitted in one task on some ``sample`` of its
    rows, drawn by hash. A query goes to as many parts of a large part as recall in that sample asks for, and to more
    until they hold more than k ids.
    """
    spark = rows.sparkSession
    routers: dict[int, Index] = {}
    if large:
        share = F.coalesce(*[F.when(F.col("part") == p, min(1.0, sample / n)) for p, n in large.items()])
        drawn = rows.where(F.col("part").isin(list(large))).where(F.pmod(hash60("vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("part", "v")

        def fit(table: pa.Table) -> pa.Table:
            p = table.column("part")[0].as_py()
            x = np.sort(_matrix(table.column("v")).view(np.dtype([(f"c{i}", float) for i in range(len(table.column("v")[0].as_py()) // 8)])).ravel())
            made = Index(x.view(float).reshape(len(x), -1)[: 2 * sample], large[p], k)
            return pa.table({"part": pa.array([p], pa.int32()), "router": pa.array([pickle.dumps(made)], pa.binary())})

        routers = {r.part: pickle.loads(r.router) for r in drawn.groupBy("part").applyInArrow(fit, "part int, router binary").collect()}
    shared = spark.sparkContext.broadcast(routers)

    def scores(router: Index, x: np.ndarray) -> np.ndarray:
        even = _scaled(x)
        return router.router.scores(even / np.sqrt((even**2).sum(1, keepdims=True)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            leaf = part * MAX_PARTS
            for p in set(part.tolist()) & set(shared.value):
                at = np.flatnonzero(part == p)
                leaf[at] += scores(shared.value[p], _matrix(batch.column("v").take(pa.array(at)))).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf.astype(np.int32))], ["vec_id", "v", "leaf"])

    leaves = rows.select("vec_id", "v", "part").mapInArrow(assign, "vec_id long, v binary, leaf int")
    if not routers:
        return leaves, queries.select("vec_id", "v", F.explode(F.transform(F.slice("probe", 1, probes), lambda p: p * MAX_PARTS)).alias("leaf"))
    leaves = materialise(leaves)
    held = {r.leaf: r.n for r in leaves.groupBy("leaf").agg(F.count_distinct("vec_id").alias("n")).collect()}  # a row for each leaf

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = _matrix(batch.column("v")), []
            for i, ranked in enumerate(batch.column("probe").to_pylist()):
                for p in ranked[:probes]:
                    router, n, found = shared.value.get(p), 0, 0
                    order = [0] if router is None else np.argsort(-scores(router, x[i : i + 1])[0], kind="stable").tolist()
                    for sub in order:
                        if router is not None and n >= router.probes and found > k:
                            break
                        out.append((i, p * MAX_PARTS + sub))
                        n, found = n + 1, found + held.get(p * MAX_PARTS + sub, 0)
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array([leaf for _, leaf in out], pa.int32())], ["vec_id", "v", "leaf"])

    return leaves, queries.select("vec_id", "v", "probe").mapInArrow(ask, "vec_id long, v binary, leaf int")


def search(vectors: DataFrame, queries: Column, *, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``queries`` holds, the k nearest found among all other rows.

    Nearest first, equal scores by smaller vec_id. Vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part, nor do rows without an id; rows that share an id are one another's own,
    and as near as the nearest of their vectors, as queries too.
    """
    index, made = build(vectors, k=k, sample=sample)
    rows = materialise(made)
    held_by = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).collect()  # a row for each part
    ids = {r.part: r.ids for r in held_by}
    parts, probes, held = (index.parts, index.probes, 0) if index else (1, 1, 0)
    for p, n in enumerate(sorted(ids.get(j, 0) for j in range(parts)), 1):
        held += n
        if held > k or p == parts:
            probes = max(probes, p)
            break
    leaves, asked = _below(rows, rows.where(queries), {r.part: r.n for r in held_by if r.n > LARGEST}, probes, k, sample)
    counted = leaves.groupBy("leaf").agg(F.count("*").alias("n")).collect()  # a row for each part of a part
    blocks = F.broadcast(vectors.sparkSession.createDataFrame([(r.leaf, -(-r.n // BLOCK)) for r in counted], "leaf int, blocks int"))
    dealt = leaves.join(blocks, "leaf").select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"))
    asked = asked.join(blocks, "leaf").select("vec_id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, r = [(t.column("vec_id").to_numpy(), _matrix(t.column("v"))) for t in (left, right)]
        return pa.Table.from_pandas(_best(q, r, k), schema, preserve_index=False)

    near = asked.groupBy("leaf", "block").cogroup(dealt.groupBy("leaf", "block")).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
