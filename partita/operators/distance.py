"""Jaccard distances between units, and starting partitions from them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.functions.special import log_of
from partita.operators.counts import cluster_counts, cluster_sizes
from partita.operators.encode import Dataset
from partita.operators.likelihood import lgamma
from partita.operators.model import CLASS_PROBABILITIES, best_of, class_priors, score_many
from partita.operators.packed import Units, blocks, pack
from partita.sources.scratch import written

#: Units of which a dendrogram is made; every cut is extended to all units.
SAMPLE = 2000
#: Units and bits of a tile at most, and units of it that are compared with another at once.
TILE, TILE_BITS, ABREAST = 2048, 1 << 24, 32
#: Words of 64 attributes that are compared in the time in which a join makes a row.
JOINED = 64
#: Rows of pairs that a task gives at once.
ROWS = 1 << 17


def _sizes(data: Dataset) -> DataFrame:
    counted = data.ones.groupBy("unit_id").agg(F.count("*").alias("c"))
    return data.units.select("unit_id").join(counted, "unit_id", "left").select("unit_id", F.coalesce("c", F.lit(0)).alias("size"))


def _distance(shared: str = "shared", a: str = "a", b: str = "b"):
    union = F.col(a) + F.col(b) - F.coalesce(F.col(shared), F.lit(0))
    return F.when(union == 0, F.lit(0.0)).otherwise(1.0 - F.coalesce(F.col(shared), F.lit(0)) / union)


class _Tile:
    """Some units as bits, 64 attributes to a word, by word and unit, with their ids and numbers of ones."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        take = lambda c, kind: np.frombuffer(batch.column(f"{c}_{side}")[row].as_py(), kind)
        self.number, self.ids, self.sizes = batch.column(f"tile_{side}")[row].as_py(), take("ids", np.int64), take("sizes", np.int64)
        self.bits = take("bits", np.uint64).reshape(-1, len(self.ids))


def _tiles(data: Dataset) -> DataFrame:
    """tile, ids, sizes, bits: all units, dealt to tiles by hash."""
    packed, ids = _packed(data)
    words = max(1, -(-len(ids) // 64))
    tiles = max(1, -(-packed.count() // max(ABREAST, min(TILE, TILE_BITS // (64 * words)))))

    def gather(table: pa.Table) -> pa.Table:
        units = Units(table)
        bits = np.zeros((words, len(units.ids)), np.uint64)
        np.bitwise_or.at(bits, (units.flat >> 6, units.row), np.uint64(1) << (units.flat & 63).astype(np.uint64))
        row = [table.column("tile")[0].as_py(), units.ids.astype(np.int64).tobytes(), units.lengths.astype(np.int64).tobytes(), bits.tobytes()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int32(), *[pa.binary()] * 3])], ["tile", "ids", "sizes", "bits"])

    dealt = packed.withColumn("tile", F.pmod(F.xxhash64("unit_id"), F.lit(tiles)).cast("int"))
    return written(dealt.groupBy("tile").applyInArrow(gather, "tile int, ids binary, sizes binary, bits binary"))


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Every two tiles, and every tile with itself, side by side; none is gathered or dealt out again."""
    a, b = tiles.alias("a"), tiles.alias("b").hint("shuffle_replicate_nl")
    return a.join(b, F.col("a.tile") <= F.col("b.tile")).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in tiles.columns])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Tile, slice, _Tile, np.ndarray]]:
    """Some units of a tile at a time, and how many ones each has in common with each unit of another."""
    for batch in batches:
        for row in range(batch.num_rows):
            a, b = _Tile(batch, row, "a"), _Tile(batch, row, "b")
            for at in range(0, len(a.ids), ABREAST):
                some = slice(at, at + ABREAST)
                shared = np.zeros((len(a.ids[some]), len(b.ids)), np.uint16 if len(a.bits) < 1024 else np.uint32)
                for x, y in zip(a.bits, b.bits):
                    shared += np.bitwise_count(x[some, None] & y[None])
                yield a, some, b, shared


def _listed(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows i, j, d with i < j from lots of ids, other ids and distances."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        x, y, d = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d)], ["i", "j", "d"])

    for lot in found:
        if len(lot[0]):
            held.append(lot)
            n += len(lot[0])
        if n >= ROWS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _bits_are_cheaper(data: Dataset, n: int, joined: float) -> bool:
    """Whether comparing n units bit by bit takes less than a join that makes so many rows."""
    return n * n / 2 * (data.attributes.count() / 64 + 4) < JOINED * joined


def _meetings(rows: DataFrame, key: str) -> float:
    """Pairs of rows that agree in a key."""
    return rows.groupBy(key).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") / 2).alias("s")).first().s or 0.0


def pairwise_distance(data: Dataset, *, tiled: bool | None = None) -> DataFrame:
    """i, j, d for all i < j: 1 less the share of common ones; two units without ones are at 0.

    All pairs are asked for, so this is for samples and tests; at scale use ``near_pairs`` or ``nearest_medoid``. Units
    are compared bit by bit, every tile of them with every other, or (``tiled`` false) meet by their ones; the cheaper
    if nothing is said.
    """
    n = data.units.count()
    if tiled or tiled is None and _bits_are_cheaper(data, n, n * n / 2 + _meetings(data.ones, "attr_id")):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for a, some, b, shared in _compared(batches):
                    x, y = np.repeat(a.ids[some], len(b.ids)), np.tile(b.ids, len(shared))
                    d = _jaccard(a.sizes[some, None], shared, b.sizes[None]).ravel()
                    kept = x < y if a.number == b.number else slice(None)
                    yield x[kept], y[kept], d[kept]

            return _listed(found())

        return _tile_pairs(_tiles(data)).mapInArrow(run, "i long, j long, d double")
    left, right = data.ones.withColumnRenamed("unit_id", "i"), data.ones.withColumnRenamed("unit_id", "j")
    common = left.join(right, "attr_id").where(F.col("i") < F.col("j")).groupBy("i", "j").agg(F.count("*").alias("shared"))
    size = _sizes(data)
    grid = size.select(F.col("unit_id").alias("i"), F.col("size").alias("a")).join(size.select(F.col("unit_id").alias("j"), F.col("size").alias("b")), F.col("i") < F.col("j"))
    return grid.join(common, ["i", "j"], "left").select("i", "j", _distance().alias("d"))


def near_pairs(data: Dataset, threshold: float, *, tiled: bool | None = None) -> DataFrame:
    """i, j, d for all pairs at most ``threshold`` apart (below 1), exactly. Units without ones are in no pair.

    A unit's attributes are ordered from the rarest on. Two units that are near have so many in common that one is
    among the first few of both, so only these are keys; common attributes hardly ever are. Of the pairs that meet,
    those stay whose sizes, and what follows the place where they met, leave room for enough common attributes.

    Where no attribute is rare, as with signs of vectors, nearly all units would meet, and more than once: then they are
    compared bit by bit, every tile of units with every other. ``tiled`` says which; the cheaper if nothing is said.
    """
    if not 0 <= threshold < 1:
        raise ValueError("a threshold from 0 to below 1 is needed")
    share = 1.0 - threshold - 1e-9
    if tiled:
        return _near_tiled(data, threshold, share)
    totals = data.ones.groupBy("attr_id").agg(F.count("*").alias("total"))
    ordered = data.ones.join(totals, "attr_id").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("total", "attr_id"))).alias("o"))
    units = written(ordered.select("unit_id", F.col("o.attr_id").alias("at"), F.size("o").alias("size")))
    needed = lambda size: F.ceil(F.lit(share) * size)
    keys = units.select("unit_id", "size", F.posexplode(F.slice("at", F.lit(1), (F.col("size") - needed(F.col("size")) + 1).cast("int"))).alias("place", "key"))
    if tiled is None and _bits_are_cheaper(data, units.count(), _meetings(keys, "key")):
        return _near_tiled(data, threshold, share)
    a, b = keys.alias("a"), keys.alias("b")
    both = F.ceil(F.lit(share / (1 + share)) * (F.col("a.size") + F.col("b.size")) - 1e-9)
    room = 1 + F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) - 1
    fits = (F.col("a.unit_id") < F.col("b.unit_id")) & (F.col("a.size") >= needed(F.col("b.size"))) & (F.col("b.size") >= needed(F.col("a.size"))) & (room >= both)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & fits).select(F.col("a.unit_id").alias("i"), F.col("b.unit_id").alias("j")).distinct()
    sides = [units.select(F.col("unit_id").alias(c), F.col("at").alias(f"{c}_at")) for c in ("i", "j")]
    common = F.size(F.array_intersect("i_at", "j_at"))
    d = 1 - common / (F.size("i_at") + F.size("j_at") - common)
    return met.join(sides[0], "i").join(sides[1], "j").select("i", "j", d.alias("d")).where(F.col("d") <= threshold + 1e-9)


def _near_tiled(data: Dataset, threshold: float, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for a, some, b, shared in _compared(batches):
                # What the smallest unit of the other tile would need; those above it are looked at one by one.
                least = np.maximum(np.floor(share / (1 + share) * (a.sizes[some] + b.sizes.min()) - 1e-6), 1)
                u, w = np.divmod(np.flatnonzero(shared >= np.minimum(least, np.iinfo(shared.dtype).max).astype(shared.dtype)[:, None]), len(b.ids))
                x, y, d = a.ids[some][u], b.ids[w], _jaccard(a.sizes[some][u], shared[u, w], b.sizes[w])
                kept = d <= threshold + 1e-9
                if a.number == b.number:
                    kept &= x < y
                yield x[kept], y[kept], d[kept]

        return _listed(found())

    return _tile_pairs(_tiles(data)).mapInArrow(run, "i long, j long, d double")


def nearest_medoid(data: Dataset, medoids: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """unit_id, cluster, d: each unit with the nearest medoid, the first of equals. ``medoids`` has cluster and unit_id."""
    size = _sizes(data)
    chosen = medoids.join(size, "unit_id").select(*keys, "cluster", F.col("unit_id").alias("medoid"), F.col("size").alias("b"))
    theirs = data.ones.join(chosen.withColumnRenamed("medoid", "unit_id"), "unit_id").select(*keys, "attr_id", "cluster")
    common = data.ones.join(theirs, "attr_id").groupBy(*keys, "unit_id", "cluster").agg(F.count("*").alias("shared"))
    grid = size.withColumnRenamed("size", "a").crossJoin(chosen)
    scored = grid.join(common, [*keys, "unit_id", "cluster"], "left").select(*keys, "unit_id", "cluster", _distance().alias("d"))
    best = scored.groupBy(*keys, "unit_id").agg(F.min(F.struct("d", "cluster")).alias("m"))
    return best.select(*keys, "unit_id", F.col("m.cluster").alias("cluster"), F.col("m.d").alias("d"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Every pair as (i, j, d) and (j, i, d), and every unit at 0 from itself."""
    turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    own = pairs.select("i").union(pairs.select("j")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"))
    return pairs.select("i", "j", "d").union(turned).union(own)


def k_medoids(pairs: DataFrame, k: int) -> DataFrame:
    """cluster and unit_id of k medoids, chosen one by one: the least total distance, then the largest improvement.

    Equal choices go to the smallest unit id. Each round is one aggregation by candidate; what is carried from round to
    round is each unit's distance to its nearest medoid.
    """
    square = written(both_ways(pairs))
    first = square.groupBy("i").agg(F.sum("d").alias("t")).orderBy(F.round("t", 9), "i").limit(1).first()
    chosen = [first.i]
    while len(chosen) < k:
        nearest = square.where(F.col("i").isin(chosen)).groupBy("j").agg(F.min("d").alias("near"))
        gain = F.sum(F.greatest(F.col("near") - F.col("d"), F.lit(0.0)))
        row = square.join(nearest, "j").where(~F.col("i").isin(chosen)).groupBy("i").agg(gain.alias("gain")).orderBy(F.desc(F.round("gain", 9)), "i").limit(1).first()
        if row is None:
            break
        chosen.append(row.i)
    return pairs.sparkSession.createDataFrame([(c, u) for c, u in enumerate(chosen, 1)], "cluster int, unit_id long")


def medoids(data: Dataset, k: int) -> DataFrame:
    """cluster and unit_id of k medoids of all units, chosen as by ``k_medoids``, without a table of all pairs.

    A round is one pass over all pairs of tiles; the medoids that are chosen go to the tasks, and each unit's distance to
    the nearest of them is found there. What comes back is a sum for each unit.
    """
    tiles = _tiles(data)
    pairs, found = _tile_pairs(tiles), []  # unit ids with their numbers of ones and bits

    def sums(chosen: list[tuple[int, int, np.ndarray]]) -> DataFrame:
        def nearest(tile: _Tile) -> np.ndarray:
            return np.min([_jaccard(tile.sizes, np.bitwise_count(tile.bits & bits[:, None]).sum(0, dtype=np.int64), size) for _, size, bits in chosen], 0)

        def value(d: np.ndarray, near: np.ndarray | None) -> np.ndarray:
            return d if near is None else np.maximum(near - d, 0.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held, near = (), {}, [None, None]
            for a, some, b, shared in _compared(batches):
                if last != (a.number, b.number):
                    last = (a.number, b.number)
                    near = [nearest(t)[v] if chosen else None for t, v in ((a, (slice(None), None)), (b, (None, slice(None))))]
                    for t in (a, b):
                        held.setdefault(t.number, (t.ids, np.zeros(len(t.ids))))
                d = _jaccard(a.sizes[some, None], shared, b.sizes[None])
                held[a.number][1][some] += value(d, near[1]).sum(1)
                if a.number != b.number:
                    held[b.number][1][:] += value(d, near[0][some] if chosen else None).sum(0)
            for ids, total in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["unit_id", "t"])

        return pairs.mapInArrow(run, "unit_id long, t double").groupBy("unit_id").agg(F.sum("t").alias("t"))

    while len(found) < k:
        total = F.round("t", 9)
        left = sums(found).where(~F.col("unit_id").isin([u for u, _, _ in found]))
        row = left.orderBy(F.desc(total) if found else total, "unit_id").limit(1).first()
        if row is None:
            break
        found.append(_of_tiles(tiles, row.unit_id))
    return data.units.sparkSession.createDataFrame([(c, u) for c, (u, _, _) in enumerate(found, 1)], "cluster int, unit_id long")


def _of_tiles(tiles: DataFrame, unit: int) -> tuple[int, int, np.ndarray]:
    """A unit with its number of ones and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in (_Tile(batch, row, "a") for row in range(batch.num_rows)):
                for at in np.flatnonzero(tile.ids == unit)[:1]:
                    yield pa.RecordBatch.from_arrays([pa.array([int(tile.sizes[at])]), pa.array([tile.bits[:, at].tobytes()])], ["size", "bits"])

    row = tiles.select(*[F.col(c).alias(f"{c}_a") for c in tiles.columns]).mapInArrow(run, "size long, bits binary").first()
    return unit, row.size, np.frombuffer(bytes(row.bits), np.uint64)


def _dendrogram_cuts(d: np.ndarray, most: int) -> np.ndarray:
    """Complete linkage: row k - 1 has the clusters (from 1) of each unit when k are left."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    cuts = np.zeros((most, n), int)
    for left in range(n, 0, -1):
        if left <= most:
            _, cuts[left - 1] = np.unique(label, return_inverse=True)
        if left > 1:
            i, j = divmod(int(np.argmin(d)), n)
            i, j = min(i, j), max(i, j)
            d[i] = np.where(alive, np.maximum(d[i], d[j]), np.inf)
            d[:, i] = d[i]
            d[i, i] = np.inf
            d[j], d[:, j], alive[j] = np.inf, np.inf, False
            label[label == j] = i
    return cuts + 1


@dataclass
class Tree:
    """A dendrogram with all units in its leaves: (unit_id, leaf), the cluster of each leaf in each cut (run_id, leaf,
    cluster), the nodes above each leaf (leaf, node), and for each node the cuts in which it is whole (from, to)."""

    leaves: DataFrame
    cuts: DataFrame
    above: DataFrame
    whole: list[tuple[int, int]]


def _jaccard(sizes: np.ndarray, shared: np.ndarray, others: np.ndarray) -> np.ndarray:
    union = sizes + others - shared
    return np.where(union == 0, 0.0, 1.0 - shared / np.maximum(union, 1))


def _matrix(table: pa.Table, m: int) -> tuple[Units, np.ndarray]:
    """Packed units in the order of their ids, and the distances between all of them."""
    units = Units(table.take(pc.sort_indices(table.column("unit_id"))))
    shared, size = np.zeros((len(units.ids),) * 2), units.lengths.astype(float)
    for low in range(0, m, 2048):
        some = (units.flat >= low) & (units.flat < low + 2048)
        y = np.zeros((len(units.ids), 2048), np.float32)
        y[units.row[some], units.flat[some] - low] = 1
        shared += y @ y.T
    return units, _jaccard(size[:, None], shared, size[None])


def _split_nodes(cuts: np.ndarray, d: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int], list[tuple[int, int]], np.ndarray]:
    """Of cuts that differ by one split each: (node, left, right) of every split, each node's medoid (a place among the
    units), the first and last cut in which it is whole, and the node of each cluster in each cut."""
    most = len(cuts)
    medoid = lambda members: int(members[np.argmin(np.round(d[np.ix_(members, members)].sum(1), 9))])
    nodes, splits, whole = [medoid(np.arange(cuts.shape[1]))], [], [[1, most]]
    at = np.zeros((most, most), int)
    for k in range(1, most):
        for c in range(1, k + 1):  # a cluster that goes on is the same node; the one that is split becomes two
            parts = np.unique(cuts[k][cuts[k - 1] == c])
            if len(parts) == 1:
                at[k, parts[0] - 1] = at[k - 1, c - 1]
                continue
            parent = int(at[k - 1, c - 1])
            whole[parent][1] = k
            for p in parts:
                at[k, p - 1] = len(nodes)
                nodes.append(medoid(np.flatnonzero(cuts[k] == p)))
                whole.append([k + 1, most])
            splits.append((parent, len(nodes) - 2, len(nodes) - 1))
    return splits, nodes, [tuple(w) for w in whole], at


def _packed(data: Dataset) -> tuple[DataFrame, np.ndarray]:
    ids = np.array(sorted(r.attr_id for r in data.attributes.select("attr_id").collect()), np.int64)
    return written(pack(data, data.units.select("unit_id", F.lit(0).alias("cluster")), ids)), ids


def _drawn(packed: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """The ``sample`` units with the smallest hashes."""
    return packed.orderBy(F.xxhash64("unit_id", F.lit(seed)), "unit_id").limit(sample)


def sample_medoids(data: Dataset, k: int, *, sample: int = SAMPLE) -> DataFrame:
    """cluster and unit_id of k medoids of at most ``sample`` units, chosen as by ``k_medoids``, in one task."""
    packed, ids = _packed(data)

    def build(table: pa.Table) -> pa.Table:
        units, d = _matrix(table, len(ids))
        chosen = [int(np.round(d.sum(0), 9).argmin())]
        while len(chosen) < min(k, len(d)):
            gain = np.round(np.maximum(d[chosen].min(0)[None] - d, 0.0).sum(1), 9)
            gain[chosen] = -1.0
            chosen.append(int(gain.argmax()))
        return pa.table({"cluster": pa.array(np.arange(1, len(chosen) + 1, dtype=np.int32)), "unit_id": pa.array(units.ids[chosen])})

    return _drawn(packed, sample).groupBy("cluster").applyInArrow(build, "cluster int, unit_id long")


def dendrogram(data: Dataset, *, sample: int = SAMPLE, seed: int = 0) -> Tree:
    """Complete linkage of at most ``sample`` units, cut into 1, 2, ... clusters; all units are routed down the tree.

    One task has the packed units of the sample. A unit starts at the root and goes, at each split, to the part with the
    nearer medoid (the first of equals): it is compared with two medoids a level, and appears once.
    """
    n, (packed, ids) = data.units.count(), _packed(data)
    drawn = _drawn(packed, sample, seed)
    most = min(n, sample, max(math.ceil(math.sqrt(n)), 100))

    def cut(table: pa.Table) -> pa.Table:
        units, d = _matrix(table, len(ids))
        splits, nodes, whole, at = _split_nodes(_dendrogram_cuts(d, most), d)
        children = {p: (left, right) for p, left, right in splits}
        place = lambda v: [int(np.flatnonzero(at[k, : k + 1] == v)[0]) for k in range(whole[v][0] - 1, whole[v][1])]
        rows = [(v, *children.get(v, (-1, -1)), *whole[v], units.flat[units.starts[u] : units.starts[u] + units.lengths[u]].tolist(), place(v)) for v, u in enumerate(nodes)]
        kinds = [pa.int32()] * 5 + [pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["node", "left", "right", "first", "last", "at", "place"])

    schema = "node int, left int, right int, first int, last int, at array<int>, place array<int>"
    nodes = sorted(drawn.groupBy("cluster").applyInArrow(cut, schema).collect())  # fewer than twice the sample
    spark = data.units.sparkSession
    medoids = np.zeros((len(nodes), len(ids)), bool)
    for v in nodes:
        medoids[v.node, v.at] = True
    shared = spark.sparkContext.broadcast((np.array([(v.left, v.right) for v in nodes]).reshape(-1, 2), medoids))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children, ones = shared.value
        sizes = ones.sum(1)
        for units in blocks(batches):
            at = np.zeros(len(units.ids), int)
            while (going := children[at, 0] >= 0).any():
                d = [_jaccard(units.lengths, units.summed(ones[children[at, side][units.row], units.flat].astype(float)), sizes[children[at, side]]) for side in (0, 1)]
                at = np.where(going, np.where(np.round(d[1], 9) < np.round(d[0], 9), children[at, 1], children[at, 0]), at)
            yield pa.RecordBatch.from_arrays([pa.array(units.ids), pa.array(at.astype(np.int32))], ["unit_id", "leaf"])

    leaves = written(packed.mapInArrow(route, "unit_id long, leaf int"))
    parent = {c: v.node for v in nodes for c in (v.left, v.right) if c >= 0}
    above = []
    for v in nodes:
        if v.left < 0:
            up = v.node
            above.append((v.node, up))
            while up in parent:
                up = parent[up]
                above.append((v.node, up))
    cuts = [(v.first + i, leaf, c + 1) for leaf, node in above for v in [nodes[node]] for i, c in enumerate(v.place)]
    return Tree(leaves, spark.createDataFrame(cuts, "run_id int, leaf int, cluster int"), spark.createDataFrame(above, "leaf int, node int"), [(v.first, v.last) for v in nodes])


def candidate_cuts(data: Dataset, *, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """run_id (the number of clusters of the sample), unit_id, cluster for every cut of a dendrogram.

    A part to which no unit is routed has no row.
    """
    tree = dendrogram(data, sample=sample, seed=seed)
    return tree.leaves.join(tree.cuts, "leaf").select("run_id", "unit_id", "cluster")


def score_cuts(data: Dataset, tree: Tree, hyper: DataFrame, g: tuple[float, float, float] = CLASS_PROBABILITIES) -> DataFrame:
    """run_id and score of every cut, from one count for each leaf and attribute.

    A node's marginals are the same in all cuts in which it is whole; a task has all nodes of some attributes and adds
    them up by cut.
    """
    leaf = tree.leaves.withColumnRenamed("leaf", "cluster")
    counts = cluster_counts(data.ones, leaf, data.attributes).join(cluster_sizes(leaf), "cluster").withColumnRenamed("cluster", "leaf")
    by_node = counts.join(tree.above, "leaf").groupBy("attr_id", "node").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).join(hyper, "attr_id")
    whole, logs = np.array(tree.whole), np.array(class_priors(g))
    most = int(whole[:, 1].max())

    def cut_scores(table: pa.Table) -> pa.Table:
        node, n, n1 = (table.column(c).to_numpy() for c in ("node", "n", "n1"))
        a, b = (np.array([table.column(f"{x}{s}")[0].as_py() for s in range(1, 5)])[:, None] for x in "ab")
        parts = lgamma(a + b) - lgamma(a) - lgamma(b) + lgamma(a + n1) + lgamma(b + n - n1) - lgamma(a + b + n)
        first, last = whole[node, 0], whole[node, 1]
        best = np.zeros(most)
        for k in range(1, most + 1):
            here = (first <= k) & (last >= k)
            held = int(here.sum())
            third, fourth = log_of((held - 1) / held), -math.log(held)
            h1, h2, h3 = parts[0, here].sum() + logs[0], parts[1, here].sum() + logs[1], np.maximum(parts[2, here] + third, parts[3, here] + fourth).sum() + logs[2]
            best[k - 1] = h3 if h3 > h2 and h3 > h1 else h1 if h3 > h2 else h2 if h2 > h1 else h1
        return pa.table({"run_id": pa.array(np.arange(1, most + 1, dtype=np.int32)), "best": pa.array(best)})

    return by_node.groupBy("attr_id").applyInArrow(cut_scores, "run_id int, best double").groupBy("run_id").agg(F.sum("best").alias("score"))


def nearest_of_first(data: Dataset, medoids: DataFrame, numbers: list[int]) -> DataFrame:
    """run_id, unit_id, cluster: each unit with the nearest of the first k medoids, the first of equals, for each k."""
    packed, ids = _packed(data)
    order = [r.unit_id for r in medoids.orderBy("cluster").collect()]
    ones = np.zeros((len(order), len(ids)))
    for r in packed.where(F.col("unit_id").isin(order)).collect():
        ones[[i for i, u in enumerate(order) if u == r.unit_id], :] = np.bincount(r["at"], minlength=len(ids))
    shared = data.units.sparkSession.sparkContext.broadcast(ones)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units in blocks(batches):
            d = np.round(_jaccard(units.lengths[:, None], units.summed(shared.value.T[units.flat]), shared.value.sum(1)[None]), 9)
            for k in numbers:
                n = len(units.ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(units.ids), pa.array((d[:, :k].argmin(1) + 1).astype(np.int32))], ["run_id", "unit_id", "cluster"])

    return packed.mapInArrow(run, "run_id int, unit_id long, cluster int")


def initial_partition(data: Dataset, hyper: DataFrame, g: tuple[float, float, float] = CLASS_PROBABILITIES, *, k_set: list[int] | None = None, sample: int = SAMPLE) -> DataFrame:
    """unit_id, cluster: the best of k-medoid partitions around the number of clusters whose cut scores best."""
    n = data.units.count()
    if k_set is None:
        best = best_of(score_cuts(data, dendrogram(data, sample=sample), hyper, g)).first().run_id
        k_set = list(range(max(1, best - 10), min(n - 1, best + 10) + 1))
    # Medoids are chosen one by one, so those of a smaller k are the first of them.
    assigned = written(nearest_of_first(data, sample_medoids(data, max(k_set), sample=sample), k_set))
    best = best_of(score_many(data, assigned, hyper, g)).first().run_id
    kept = assigned.where(F.col("run_id") == best)
    numbers = {c: k for k, c in enumerate(sorted(r.cluster for r in kept.select("cluster").distinct().collect()), 1)}  # a row for each cluster
    renumbered = F.element_at(F.create_map(*[x for c, k in numbers.items() for x in (F.lit(c), F.lit(k))]), F.col("cluster"))
    return kept.select("unit_id", renumbered.alias("cluster"))
