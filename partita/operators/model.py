"""The Beta-Bernoulli model: scores of partitions, states of attributes in clusters, classes of attributes.

States are 1 noise, 2 weak signal, 3 strong signal of other clusters, 4 strong signal of this one; a class is 1, 2 or 3.
``keys`` are columns, such as ``run_id``, by which several partitions are scored side by side in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.functions.special import MINUS_INFINITY, lgamma, log_of
from partita.operators.counts import attribute_totals, cluster_counts, cluster_sizes
from partita.operators.encode import Dataset

#: The strength of a characteristic value, and probabilities of the three classes.
STRENGTH = math.log(0.001) / math.log(0.95)
CLASS_PROBABILITIES = (0.6, 0.35, 0.05)


def hyper_parameters(totals: DataFrame, n: int, r: float = STRENGTH) -> DataFrame:
    """attr_id, a1..a4, b1..b4 from the ones of each attribute among n units."""
    total = F.col("total").cast("double")
    a1 = F.lit(r + 1) * (total + 0.5) / F.lit(float(n + 1)) if n > r else total + 0.5
    b1 = F.lit(r + 1) - a1 if n > r else F.lit(n + 0.5) - total
    rest = ((1.0, 1.0), (1.0, r), (r, 1.0))
    return totals.select(
        "attr_id", a1.alias("a1"), *[F.lit(a).alias(f"a{s}") for s, (a, _) in enumerate(rest, 2)],
        b1.alias("b1"), *[F.lit(b).alias(f"b{s}") for s, (_, b) in enumerate(rest, 2)],
    )


def class_priors(g: tuple[float, float, float] = CLASS_PROBABILITIES) -> tuple[float, float, float, float]:
    """Logarithms of the class probabilities, made to sum to one, for the four states."""
    if len(g) != 3 or min(g) < 0 or sum(g) <= 0:
        raise ValueError("three class probabilities that are not negative are needed")
    logs = [log_of(x / sum(g)) for x in g]
    return (*logs, logs[2])


def state_priors(k: Column) -> tuple[Column, Column, Column, Column]:
    """Logarithms of the state probabilities with k clusters; with one cluster state 3 cannot be."""
    one = k == 1
    third = F.when(one, F.lit(MINUS_INFINITY)).otherwise(F.ln(k - 1) - F.ln(k))
    return F.lit(0.0), F.lit(0.0), third, -F.ln(k)


def beta_bernoulli(a: Column, b: Column, n: Column, n1: Column) -> Column:
    """Log marginal of n1 ones among n under a Beta(a, b) prior."""
    return lgamma(a + b) - lgamma(a) - lgamma(b) + lgamma(a + n1) + lgamma(b + n - n1) - lgamma(a + b + n)


def _counted(data: Dataset, partition: DataFrame, hyper: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """cluster, attr_id, n1 with n, the number of clusters and the hyper-parameters beside it."""
    sizes = cluster_sizes(partition, keys)
    k = sizes.groupBy(*keys).agg(F.count("*").alias("k"))
    sized = sizes.join(k, list(keys)) if keys else sizes.crossJoin(k)
    counts = cluster_counts(data.ones, partition, data.attributes, keys)
    return counts.join(sized, [*keys, "cluster"]).join(hyper, "attr_id")


def state_scores(data: Dataset, partition: DataFrame, hyper: DataFrame, g: tuple[float, float, float] = CLASS_PROBABILITIES, keys: tuple[str, ...] = ()) -> DataFrame:
    """cluster, attr_id, n, n1, k and the scores l1..l4 of the four states."""
    rows = _counted(data, partition, hyper, keys)
    n, n1, k = F.col("n").cast("double"), F.col("n1").cast("double"), F.col("k").cast("double")
    logs = class_priors(g)
    scores = [
        (beta_bernoulli(F.col(f"a{s + 1}"), F.col(f"b{s + 1}"), n, n1) + F.lit(logs[s]) / k + state_priors(k)[s]).alias(f"l{s + 1}")
        for s in range(4)
    ]
    return rows.select(*keys, "cluster", "attr_id", "n", "n1", "k", *[f"{x}{s}" for x in "ab" for s in range(1, 5)], *scores)


def classify_attributes(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """attr_id, h1, h2, h3, class and best (the score of that class); ties go to the lower class."""
    sums = scores.groupBy(*keys, "attr_id").agg(F.sum("l1").alias("h1"), F.sum("l2").alias("h2"), F.sum(F.greatest("l3", "l4")).alias("h3"))
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    kind = F.when((h3 > h2) & (h3 > h1), 3).when(h3 > h2, 1).when(h2 > h1, 2).otherwise(1)
    return sums.withColumn("class", kind).withColumn("best", F.when(F.col("class") == 3, h3).when(F.col("class") == 2, h2).otherwise(h1))


def states(scores: DataFrame, classes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cluster, attr_id, state: the class, and 4 instead of 3 where the value is characteristic of the cluster."""
    state = F.when((F.col("class") == 3) & (F.col("l4") > F.col("l3")), 4).otherwise(F.col("class"))
    return scores.join(classes.select(*keys, "attr_id", "class"), [*keys, "attr_id"]).select(*keys, "cluster", "attr_id", state.alias("state"))


def default_hyper(data: Dataset, r: float = STRENGTH) -> DataFrame:
    """Hyper-parameters from the data set's own totals and number of units."""
    n = data.units.agg(F.count("*").alias("n")).first().n
    return hyper_parameters(attribute_totals(data.ones, data.attributes), n, r)


def score_many(data: Dataset, partitions: DataFrame, hyper: DataFrame, g: tuple[float, float, float] = CLASS_PROBABILITIES) -> DataFrame:
    """run_id and score of every partition in ``partitions`` (run_id, unit_id, cluster), in one job."""
    classes = classify_attributes(state_scores(data, partitions, hyper, g, ("run_id",)), ("run_id",))
    return classes.groupBy("run_id").agg(F.sum("best").alias("score"))


def best_of(scores: DataFrame) -> DataFrame:
    """run_id and score of the best partition, the first of equals."""
    return scores.orderBy(F.desc("score"), "run_id").limit(1)


def score_partition(data: Dataset, partition: DataFrame, hyper: DataFrame, g: tuple[float, float, float] = CLASS_PROBABILITIES) -> DataFrame:
    """One row: the maximum log posterior of a partition."""
    return classify_attributes(state_scores(data, partition, hyper, g)).agg(F.sum("best").alias("score"))


def cluster_marginals(data: Dataset, partition: DataFrame, hyper: DataFrame, state: int = 1) -> DataFrame:
    """cluster and the log marginal of its data, with the hyper-parameters of one state."""
    rows = _counted(data, partition, hyper, ())
    value = beta_bernoulli(F.col(f"a{state}"), F.col(f"b{state}"), F.col("n").cast("double"), F.col("n1").cast("double"))
    return rows.select("cluster", value.alias("v")).groupBy("cluster").agg(F.sum("v").alias("log_marginal"))
