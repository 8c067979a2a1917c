import math
import os
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_model import _planted

from partita.operators import assign, cocluster, distance, model, search
from partita.operators.encode import profile_sites, value_counts
from partita.sources.scratch import Tables, written
from partita.sources.tables import from_table
from partita.streaming import profile


@pytest.mark.parametrize("exact", [4_000_000, 0])  # 0: every cluster counts as large, gains come from histograms
def test_search_never_lowers_the_score_and_finds_planted_clusters(spark, tmp_path, monkeypatch, exact):
    monkeypatch.setattr(search, "EXACT", exact)
    data, truth = _planted(spark, 45, 10)
    hyper = written(model.default_hyper(data))
    start = written(truth.select("unit_id", F.when(F.col("unit_id") % 15 == 0, F.col("cluster") % 3 + 1).otherwise(F.col("cluster")).alias("cluster")))
    found = search.search(data, start, hyper, keep=str(tmp_path / "rounds"))
    assert all(b > a for a, b in zip(found.history, found.history[1:], strict=False)) and len(found.history) > 1
    assert found.score >= model.score_partition(data, truth, hyper).first().score - 1e-9
    again = model.score_partition(data, found.partition, hyper).first().score
    assert abs(again - found.score) < 1e-6
    last = search.resume(spark, str(tmp_path / "rounds"))
    assert last.count() == 45 and abs(model.score_partition(data, last, hyper).first().score - found.score) < 1e-6


def _start(spark, n=45):
    data, truth = _planted(spark, n, 6)
    hyper = written(model.default_hyper(data))
    part = written(truth.select("unit_id", F.when(F.col("unit_id") % 9 < 2, 4).when(F.col("unit_id") == n - 1, 5).otherwise(F.col("cluster")).alias("cluster")))
    return data, hyper, part, search.position(data, part, hyper)


@pytest.mark.parametrize("exact", [4_000_000, 0])
def test_scores_of_proposals_equal_those_of_whole_partitions(spark, monkeypatch, exact):
    monkeypatch.setattr(search, "EXACT", exact)
    data, hyper, part, at = _start(spark)
    assert abs(at.model.score() - model.score_partition(data, part, hyper).first().score) < 1e-9
    scores = model.state_scores(data, part, hyper)
    for r in model.states(scores, model.classify_attributes(scores)).collect():
        assert at.model.states()[r.cluster - 1, np.searchsorted(at.ids, r.attr_id)] == r.state
    for level in search.LEVELS:
        proposals = search.scored(at, [p for f in level for p in f(at) or []])
        assert proposals or level == search.LEVELS[2]
        runs = [search._applied(at, [(p.target, p)]).withColumn("run_id", F.lit(i)).select("run_id", "unit_id", "cluster") for i, p in enumerate(proposals[:12])]
        if runs:
            every = written(reduce(DataFrame.unionByName, runs))
            for r in model.score_many(data, every, hyper).collect():
                assert abs(r.score - proposals[r.run_id].score) < 1e-9
    chosen = search._together(at, search.scored(at, search.collect_from_cluster(at) + search.split_cluster(at)), at.model.score(), None)
    whole = written(search._applied(at, chosen[1]))
    assert abs(model.score_partition(data, whole, hyper).first().score - chosen[0]) < 1e-9
    assert sorted(r.cluster for r in whole.select("cluster").distinct().collect()) == list(range(whole.select("cluster").distinct().count()))


def _dense(data, part):
    ones, units = {}, sorted((r.unit_id, r.cluster - 1) for r in part.collect())
    for r in data.ones.collect():
        ones.setdefault(r.unit_id, set()).add(r.attr_id)
    return ones, units


def _own(at, y, k, n, n1):
    a, b = at.model.effective()
    return sum(math.log(a[k, j] + n1[j] if y[j] else b[k, j] + n - n1[j]) - math.log(a[k, j] + b[k, j] + n) for j in range(len(y)))


def test_exchanges_equal_all_pairs(spark, monkeypatch):
    data, hyper, part, at = _start(spark, 24)
    ones, units = _dense(data, part)
    ys = {u: np.array([int(a in ones.get(u, ())) for a in at.ids]) for u, _ in units}
    want = {}
    for i, k in units:
        for j, w in units:
            if k < w:
                nk, nw, sk, sw = at.model.n[k] - 1, at.model.n[w] - 1, at.model.n1[k] - ys[i], at.model.n1[w] - ys[j]
                gain = _own(at, ys[i], w, nw, sw) + _own(at, ys[j], k, nk, sk) - _own(at, ys[i], k, nk, sk) - _own(at, ys[j], w, nw, sw)
                if gain > 1e-8:
                    want[k, w] = max(want.get((k, w), 0), gain)
    assert want
    for block in (4_000_000, 3 * at.model.m):  # all in one block, and three units in a block
        monkeypatch.setattr(search, "EXACT", block)
        got = {(k, w): gain for gain, k, _, w, *_ in search.swaps(at)}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)


def test_single_gains_are_those_of_the_dataframe_operators(spark):
    data, hyper, part, at = _start(spark)
    scores = model.state_scores(data, part, hyper)
    rows = written(assign.effective(scores, model.states(scores, model.classify_attributes(scores))))
    gains = assign.move_gains(assign.unit_own_score(data, part, rows), assign.unit_cluster_scores(data, rows))
    want = {(r.source - 1, r.target - 1): (r.n, r.gain, r.every) for r in gains.groupBy("source", "target").agg(F.sum((F.col("gain") > 1e-9).cast("int")).alias("n"), F.sum(F.greatest("gain", F.lit(0.0))).alias("gain"), F.sum("gain").alias("every")).collect()}
    got = {(s, t): (n, gain, every) for s, t, n, gain, every in search.pair_sums(at)}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and np.allclose(got[p], want[p], atol=1e-6) for p in want)


def test_histograms_give_prefixes_by_gain(spark):
    _, _, _, at = _start(spark)
    columns, own = at.clusters(), at.model.own_weights()
    units = search._Units(at.members.toArrow())
    gains = units.gains(columns, own)[:, 1][units.cluster != 1]
    (steps,) = search.histograms(at, columns, [search._Rule(1, search.EVERY, 1, -np.inf)])
    assert steps[-1][1] == len(gains) and [n for _, n in steps] == sorted({n for _, n in steps})
    for low, n in steps:
        assert (gains >= low).sum() == n
    assert [sum(g >= low for g in gains) for low in search._prefixes(steps, 10)] == sorted({n for n in [next((n for _, n in steps if n >= t), 99) for t in (1, 2, 4, 8)] + [max(n for _, n in steps if n <= 10)] if n <= 10})


def test_growth_by_hand():
    """The best prefix is found beyond a fall, a fall that gets steeper below zero ends it, the last unit adds a term."""
    def by(gains):
        return lambda left, order: np.array([sum(gains[i] for i in order) + g for g in gains], float)

    assert search._grow(4, by([3, 1, -1, -5]), 0.0, 0) == (4.0, [0, 1])
    assert search._grow(3, by([-1, -2, 9]), 0.0, 0) == (9.0, [2])
    assert search._grow(3, by([-1, -2, -4]), 20.0, 0) == (0.0, [])  # ends before the term could count
    assert search._grow(2, by([-1, -1]), 20.0, 0) == (18.0, [0, 1])
    assert search._grow(2, by([5, 5]), 0.0, 1) == (5.0, [0])


def test_two_planted_in_one_are_split_exactly(spark):
    data, truth = _planted(spark, 36, 12)
    joined = written(truth.select("unit_id", F.least("cluster", F.lit(2)).alias("cluster")))
    at = search.position(data, joined, written(model.default_hyper(data)))
    best = search.scored(at, search.split_cluster(at))[0]
    moved = {r.unit_id for r in search._applied(at, [(best.target, best)]).where("cluster = 2").collect()}
    parts = [{r.unit_id for r in truth.where(f"cluster = {c}").collect()} for c in (2, 3)]
    assert list(best.moved) == [1] and moved in parts


def test_limits_of_the_search(spark):
    data, hyper, part, at = _start(spark)
    assert search.search(data, part, hyper, max_clusters=5).partition.select("cluster").distinct().count() <= 5
    assert len(search.search(data, part, hyper, max_rounds=1).history) <= 2
    one = search.search(data, part.withColumn("cluster", F.lit(7)), hyper)
    assert one.score >= one.history[0]
    single = search.search(data, part.withColumn("cluster", F.col("unit_id").cast("int")), hyper)
    assert single.score > single.history[0] and single.partition.select("cluster").distinct().count() < 45


def test_distances_and_medoids(spark):
    data, _ = _planted(spark, 24, 6)
    pairs = written(distance.pairwise_distance(data))
    ones = {}
    for r in data.ones.collect():
        ones.setdefault(r.unit_id, set()).add(r.attr_id)
    for r in pairs.collect():
        assert abs(r.d - (1 - len(ones[r.i] & ones[r.j]) / len(ones[r.i] | ones[r.j]))) < 1e-12
    assert pairs.count() == 24 * 23 // 2
    for t in (0.0, 0.2, 0.4, 0.75):
        near = sorted((r.i, r.j) for r in distance.near_pairs(data, t).collect())
        assert near == sorted((r.i, r.j) for r in pairs.where(f"d <= {t + 1e-9}").collect())
    part = distance.initial_partition(data, model.default_hyper(data), k_set=[2, 3, 4], sample=24)
    assert part.count() == 24
    cuts = written(distance.candidate_cuts(data, sample=12))
    assert cuts.groupBy("run_id").count().where("count != 24").count() == 0 and cuts.agg(F.max("run_id")).first()[0] == 12
    hyper = written(model.default_hyper(data))
    scores = {r.run_id: r.score for r in distance.score_cuts(data, distance.dendrogram(data, sample=12), hyper).collect()}
    for r in model.score_many(data, cuts, hyper).collect():
        assert abs(r.score - scores[r.run_id]) < 1e-8
    # Each cut splits one cluster of the one before, and the whole sample is cut as the dendrogram says.
    by = {}
    for r in distance.candidate_cuts(data, sample=24).collect():
        by.setdefault(r.run_id, {}).setdefault(r.cluster, set()).add(r.unit_id)
    for k in range(2, 25):
        assert len({frozenset(x) for x in by[k].values()} - {frozenset(x) for x in by[k - 1].values()}) in (0, 1, 2)
    chosen = distance.k_medoids(pairs, 5)
    assert sorted(distance.sample_medoids(data, 5).collect()) == sorted(chosen.collect())
    together = {(r.run_id, r.unit_id): r.cluster for r in distance.nearest_of_first(data, chosen, [2, 5]).collect()}
    for k in (2, 5):
        for r in distance.nearest_medoid(data, chosen.where(F.col("cluster") <= k)).collect():
            assert together[k, r.unit_id] == r.cluster


def test_cocluster_against_numpy(spark):
    data, _ = _planted(spark, 12, 4)
    units, attrs = sorted(r.unit_id for r in data.units.collect()), sorted(r.attr_id for r in data.attributes.collect())
    x = np.zeros((len(units), len(attrs)))
    for r in data.ones.collect():
        x[units.index(r.unit_id), attrs.index(r.attr_id)] = 1
    rng = np.random.default_rng(1)
    w, h = rng.random((len(units), 2)), rng.random((len(attrs), 3))
    ws = spark.createDataFrame([(u, [float(v) for v in w[k]]) for k, u in enumerate(units)], "unit_id long, w array<double>")
    hs = spark.createDataFrame([(a, [float(v) for v in h[k]]) for k, a in enumerate(attrs)], "attr_id int, h array<double>")
    entries = cocluster.entries_of(data)
    assert abs(cocluster.objective(entries, ws, hs) - ((x - w @ w.T @ x @ h @ h.T) ** 2).sum()) < 1e-6
    w2, h2, values = cocluster.fit(entries, ws, hs, max_iter=2)
    w3, h3, joined = cocluster._fit_joined(entries, ws, hs, 2, 1e-8)
    assert np.allclose(values, joined) and np.allclose([r.w for r in w3.orderBy("unit_id").collect()], [r.w for r in w2.orderBy("unit_id").collect()])
    for _ in range(2):
        wxh, ww, hh, xh, eps = w.T @ x @ h, w.T @ w, h.T @ h, x @ h, np.finfo(float).eps
        w = w * ((2 * xh @ wxh.T) / (w @ wxh @ hh @ wxh.T + xh @ hh @ wxh.T @ ww + eps)) ** 0.25
        xw = x.T @ w
        wxh, ww = xw.T @ h, w.T @ w
        h = h * ((2 * xw @ wxh) / (xw @ ww @ wxh @ hh + h @ wxh.T @ ww @ wxh + eps)) ** 0.25
    assert np.allclose([r.w for r in w2.orderBy("unit_id").collect()], w)
    assert np.allclose([r.h for r in h2.orderBy("attr_id").collect()], h)
    assert np.allclose(values[-1], ((x - w @ w.T @ x @ h @ h.T) ** 2).sum()) and len(values) == 3
    right, sigma = cocluster.leading_directions(data, 3)
    assert np.allclose(sigma, np.linalg.svd(x)[1][:3], atol=1e-6)
    v = np.array([r.h for r in right.orderBy("attr_id").collect()])
    assert np.allclose(np.abs(np.diag(np.linalg.svd(x)[2][:3] @ v)), 1, atol=1e-4)
    a, b = cocluster.svd_init(data, 2, 2)
    assert a.count() == 12 and all(sum(r.w) == 1 for r in a.collect()) and all(sum(r.h) == 1 for r in b.collect())


def test_stream_profile_counts_each_batch_once(spark, tmp_path):
    """A stream that fails after a batch was written, before it was noted as done, ends equal to the batch profile."""
    rows = spark.createDataFrame([(i, str(i % 3), "x") for i in range(50)], "id long, a string, b string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    profiled = profile.Profile(str(tmp_path / "counts"), every=2)

    def begin(after=None):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        cells = lambda records: from_table(records, "id", ["a", "b"])
        return profiled.start(stream, cells, str(tmp_path / "checkpoint"), after=after)

    def fail(batch):
        if batch == 3:
            raise RuntimeError("lost")

    broken = begin(fail)
    with pytest.raises(Exception, match="lost"):
        broken.processAllAvailable()
    again = begin()
    again.processAllAvailable()
    again.stop()
    batch = value_counts(from_table(rows, "id", ["a", "b"]))
    assert sorted(profiled.counts(spark).collect()) == sorted(batch.collect())
    assert sorted(profiled.sites(spark).collect()) == sorted(profile_sites(batch).collect())


def test_a_level_goes_on_to_later_batches(spark, monkeypatch):
    _, _, _, at = _start(spark)
    tried = []

    def late(at, batch=None):
        tried.append(batch)
        return [] if batch < 3 else None

    monkeypatch.setattr(search, "LEVELS", ((late,),))
    assert search.improved(at, 0) is None and tried == [0, 1, 2, 3]
    monkeypatch.setattr(search, "PROPOSALS", 2)
    assert [len(search._cut([1, 2, 3], b) or []) for b in range(3)] == [2, 1, 0]


def test_tables_of_an_iteration_are_removed(spark):
    tables = Tables(keep=2)
    made = [tables.written(spark.range(k + 1)) for k in range(4)]
    assert len(tables.paths) == 2 and made[-1].count() == 4 and made[-2].count() == 3
    there = [os.path.exists(p.removeprefix("file://")) for p in tables.paths]
    tables.drop()
    assert there == [True, True] and tables.paths == []


def test_cofactors_are_fitted_to_their_tolerance(spark):
    data, _ = _planted(spark, 24, 5)
    units, attrs = sorted(r.unit_id for r in data.units.collect()), sorted(r.attr_id for r in data.attributes.collect())
    x = np.zeros((len(units), len(attrs)))
    for r in data.ones.collect():
        x[units.index(r.unit_id), attrs.index(r.attr_id)] = 1
    rng = np.random.default_rng(5)
    w, h = rng.random((len(units), 2)), rng.random((len(attrs), 2))
    ws = spark.createDataFrame([(u, [float(v) for v in w[k]]) for k, u in enumerate(units)], "unit_id long, w array<double>").repartition(3)
    hs = spark.createDataFrame([(a, [float(v) for v in h[k]]) for k, a in enumerate(attrs)], "attr_id int, h array<double>")
    made, _, values = cocluster.fit(cocluster.entries_of(data), ws, hs, tolerance=1e-4)
    own = [((x - w @ w.T @ x @ h @ h.T) ** 2).sum()]
    while len(own) < 2 or abs(own[-1] - own[-2]) >= 1e-4 * abs(own[-2]):
        wxh, ww, hh, xh, eps = w.T @ x @ h, w.T @ w, h.T @ h, x @ h, np.finfo(float).eps
        w = w * ((2 * xh @ wxh.T) / (w @ wxh @ hh @ wxh.T + xh @ hh @ wxh.T @ ww + eps)) ** 0.25
        xw = x.T @ w
        wxh, ww = xw.T @ h, w.T @ w
        h = h * ((2 * xw @ wxh) / (xw @ ww @ wxh @ hh + h @ wxh.T @ ww @ wxh + eps)) ** 0.25
        own.append(((x - w @ w.T @ x @ h @ h.T) ** 2).sum())
    assert len(values) == len(own) and np.allclose(values, own)
    got = cocluster.assign_argmax(made, "unit_id", "w").orderBy("unit_id").collect()
    assert [r.cluster - 1 for r in got] == list(w.argmax(1))


def test_a_search_that_is_resumed_ends_as_one_that_was_not(spark, tmp_path):
    data, hyper, part, _ = _start(spark, 18)
    whole = search.search(data, part, hyper)
    first = search.search(data, part, hyper, max_rounds=1, keep=str(tmp_path / "rounds"))
    rest = search.search(data, search.resume(spark, str(tmp_path / "rounds")), hyper)
    assert first.history == whole.history[:2] and abs(rest.score - whole.score) < 1e-9


def test_searches_side_by_side_end_as_one_after_the_other(spark, tmp_path):
    data, hyper, part, _ = _start(spark, 18)
    starts = [part, part.withColumn("cluster", F.lit(1)), part.withColumn("cluster", (F.col("unit_id") % 2 + 1).cast("long"))]
    alone = [search.search(data, s, hyper) for s in starts]
    together = search.searches(data, starts, hyper)
    assert [r.history for r in together] == [r.history for r in alone]
    labels = lambda r: sorted(map(tuple, r.partition.select("unit_id", "cluster").collect()))
    assert [labels(r) for r in together] == [labels(r) for r in alone]

    cut = search.searches(data, starts, hyper, max_rounds=1, keep=str(tmp_path / "first"))
    assert [r.history for r in cut] == [r.history[:2] for r in alone]
    left = search.resume_runs(spark, str(tmp_path / "first"))
    rest = search.searches(data, left, hyper, keep=str(tmp_path / "second"))
    assert [r.score for r in rest] == pytest.approx([r.score for r in alone], abs=1e-9)
    ends = [model.score_partition(data, p, hyper).first().score for p in search.resume_runs(spark, str(tmp_path / "second"))]
    assert ends == pytest.approx([r.score for r in alone], abs=1e-6)
    assert search.best_of_restarts(data, starts, hyper, max_rounds=1).score == max(r.score for r in cut)


def test_no_local_folder_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from partita.sources.scratch import shared_folder

    conf = lambda base: SimpleNamespace(get=lambda key, default=None: base)
    cluster = SimpleNamespace(master="local-cluster[2,1,1024]")
    assert shared_folder(SimpleNamespace(conf=conf("hdfs://x/y/"), sparkContext=cluster)) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf(None), sparkContext=cluster))
