"""Scores of units in clusters. Work follows the ones of a unit, not all attributes.

A score is a sum over attributes of w1 where the unit has the one and w0 where not; it is written as the sum of all w0
plus the sum of (w1 - w0) over the unit's ones. Units without ones keep the first sum: they come from ``units``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.special import log_of
from partita.operators.counts import by_unit
from partita.operators.encode import Dataset
from partita.operators.model import CLASS_PROBABILITIES, beta_bernoulli, class_priors, state_priors

#: Clusters whose differences stand side by side in a row.
ABREAST = 64


def effective(scores: DataFrame, states: DataFrame) -> DataFrame:
    """cluster, attr_id, n, n1, k, state and the a, b of the state the attribute is in; all four pairs beside them."""
    pick = lambda x: F.when(F.col("state") == 1, F.col(f"{x}1")).when(F.col("state") == 2, F.col(f"{x}2")).when(F.col("state") == 3, F.col(f"{x}3")).otherwise(F.col(f"{x}4"))
    joined = scores.join(states, ["cluster", "attr_id"])
    return joined.select("cluster", "attr_id", "n", "n1", "k", "state", *[f"{x}{s}" for x in "ab" for s in range(1, 5)], pick("a").alias("a"), pick("b").alias("b"))


def _own_weights(rows: DataFrame) -> DataFrame:
    """w0 and w1 of a member in its own cluster without itself.

    Where all members have the one, w0 would be the logarithm of b - 1; no member needs it, so it is set to w1. Where
    none has, w1 is set to w0.
    """
    a, b, n, n1 = F.col("a"), F.col("b"), F.col("n").cast("double"), F.col("n1").cast("double")
    all_ones, no_ones = F.col("n1") == F.col("n"), F.col("n1") == 0
    w1, w0 = F.ln(a + n1 - 1), F.ln(b + n - 1 - n1)
    rest = F.ln(a + b + n - 1)
    return rows.select("cluster", "attr_id", (F.when(all_ones, w1).otherwise(w0) - rest).alias("w0"), (F.when(no_ones, w0).otherwise(w1) - rest).alias("w1"))


def _other_weights(rows: DataFrame) -> DataFrame:
    """w0 and w1 of a unit that joins a cluster."""
    a, b, n, n1 = F.col("a"), F.col("b"), F.col("n").cast("double"), F.col("n1").cast("double")
    rest = F.ln(a + b + n)
    return rows.select("cluster", "attr_id", (F.ln(b + n - n1) - rest).alias("w0"), (F.ln(a + n1) - rest).alias("w1"))


def unit_own_score(data: Dataset, partition: DataFrame, rows: DataFrame) -> DataFrame:
    """unit_id, cluster, own: log probability of each unit given the rest of its cluster."""
    weights = _own_weights(rows)
    base = weights.groupBy("cluster").agg(F.sum("w0").alias("base"))
    here = data.ones.join(by_unit(partition), "unit_id").join(weights.select("cluster", "attr_id", (F.col("w1") - F.col("w0")).alias("d")), ["cluster", "attr_id"])
    sums = here.groupBy("unit_id").agg(F.sum("d").alias("d"))
    return partition.join(base, "cluster").join(sums, "unit_id", "left").select("unit_id", "cluster", (F.col("base") + F.coalesce("d", F.lit(0.0))).alias("own"))


def _per_cluster(data: Dataset, weights: DataFrame, name: str) -> DataFrame:
    """Sums over a unit's ones for every cluster. An attribute has one row with its differences in ``ABREAST`` clusters,
    so a one of a unit stays one row up to the sum, however many clusters there are."""
    clusters = sorted(weights.groupBy("cluster").agg(F.sum("w0").alias("base")).collect())  # a row for each cluster
    if not clusters:
        return data.units.select("unit_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias(name)).limit(0)
    kind, out = weights.schema["cluster"].dataType, []
    for at in range(0, len(clusters), ABREAST):
        some = clusters[at : at + ABREAST]
        difference = F.col("w1") - F.col("w0")
        delta = weights.groupBy("attr_id").agg(*[F.sum(F.when(F.col("cluster") == r.cluster, difference)).alias(f"d{k}") for k, r in enumerate(some)])
        sums = data.ones.join(delta, "attr_id").groupBy("unit_id").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(len(some))])
        scores = F.array(*[F.struct(F.lit(r.cluster).cast(kind).alias("cluster"), (F.lit(r.base) + F.coalesce(f"d{k}", F.lit(0.0))).alias(name)) for k, r in enumerate(some)])
        out.append(data.units.select("unit_id").join(sums, "unit_id", "left").select("unit_id", F.inline(scores)))
    return reduce(DataFrame.union, out)


def unit_cluster_scores(data: Dataset, rows: DataFrame) -> DataFrame:
    """unit_id, cluster, score: log probability of each unit given each cluster as it stands."""
    return _per_cluster(data, _other_weights(rows), "score")


def new_cluster_scores(data: Dataset, rows: DataFrame, g: tuple[float, float, float] = CLASS_PROBABILITIES) -> DataFrame:
    """unit_id, cluster, score of each cluster once the unit has joined it, as one cluster more than there are.

    Attributes of classes 1 and 2 keep their state; of class 3, state 3 or 4 is chosen anew for the joined cluster.
    """
    logs, k = class_priors(g), F.col("k").cast("double") + 1
    strong = F.max((F.col("state") > 2).cast("int")).over(Window.partitionBy("attr_id")) == 1

    def value(n1: Column) -> Column:
        at = [beta_bernoulli(F.col(f"a{s}"), F.col(f"b{s}"), F.col("n").cast("double") + 1, n1) + F.lit(logs[s - 1]) / k + state_priors(k)[s - 1] for s in range(1, 5)]
        return F.when(F.col("strong"), F.greatest(at[2], at[3])).when(F.col("state") == 2, at[1]).otherwise(at[0])

    weights = rows.withColumn("strong", strong).select("cluster", "attr_id", value(F.col("n1").cast("double")).alias("w0"), value(F.col("n1").cast("double") + 1).alias("w1"))
    return _per_cluster(data, weights, "score")


def move_gains(own: DataFrame, scores: DataFrame) -> DataFrame:
    """unit_id, source, target, gain of moving each unit to each other cluster."""
    joined = scores.withColumnRenamed("cluster", "target").join(own.withColumnRenamed("cluster", "source"), "unit_id")
    return joined.where(F.col("source") != F.col("target")).select("unit_id", "source", "target", (F.col("score") - F.col("own")).alias("gain"))


def best_move_per_unit(gains: DataFrame) -> DataFrame:
    """source, target, unit_id, gain: for each pair of clusters the unit that gains most, the smallest id of equals."""
    best = gains.groupBy("source", "target").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "unit_id")).alias("m"))
    return best.select("source", "target", "m.unit_id", (-F.col("m.loss")).alias("gain"))


def merge_term(k: int, g: tuple[float, float, float], states: DataFrame) -> DataFrame:
    """cluster and the change of the priors when that cluster is merged into another, from k clusters to k - 1."""
    logs = class_priors(g)
    gp = lambda s: F.when(s == 1, F.lit(logs[0])).when(s == 2, F.lit(logs[1])).otherwise(F.lit(logs[2]))
    op = lambda s, n: F.when(s == 3, F.lit(log_of((n - 1) / n))).when(s == 4, F.lit(log_of(1 / n))).otherwise(F.lit(0.0))
    s = F.col("state")
    stays = gp(s) / (k * (k - 1)) + op(s, k - 1) - op(s, k)
    goes = gp(s) / k + op(s, k)
    sums = states.groupBy("cluster").agg(F.sum(stays).alias("stays"), F.sum(goes).alias("goes"))
    total = sums.agg(F.sum("stays").alias("total"))
    return sums.crossJoin(total).select("cluster", (F.col("total") - F.col("stays") - F.col("goes")).alias("phi"))
