"""Counts and labels. ``partition`` has unit_id and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_unit(rows: DataFrame) -> DataFrame:
    """``rows`` of units as the side of a join with ones that is hashed, partition by partition.

    Files of ones are many times smaller than their rows, so going by their size Spark would gather all ones in the driver.
    """
    return rows.hint("shuffle_hash")


def attribute_totals(ones: DataFrame, attributes: DataFrame) -> DataFrame:
    """attr_id and total: ones of each attribute."""
    return attributes.select("attr_id").join(ones.groupBy("attr_id").agg(F.count("*").alias("n")), "attr_id", "left").select("attr_id", F.coalesce("n", F.lit(0)).alias("total"))


def cluster_sizes(partition: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cluster and n: units of each cluster, those with missing cells included."""
    return partition.groupBy(*keys, "cluster").agg(F.count("*").alias("n"))


def cluster_counts(ones: DataFrame, partition: DataFrame, attributes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cluster, attr_id, n1, with a row of 0 where a cluster has no one of an attribute.

    The map-side combine leaves a row for each cluster and attribute of a task, so frequent values are no hot keys.
    """
    counted = ones.join(by_unit(partition), "unit_id").groupBy(*keys, "cluster", "attr_id").agg(F.count("*").alias("n1"))
    grid = partition.select(*keys, "cluster").distinct().crossJoin(attributes.select("attr_id"))
    return grid.join(counted, [*keys, "cluster", "attr_id"], "left").select(*keys, "cluster", "attr_id", F.coalesce("n1", F.lit(0)).alias("n1"))


def relabel(labels: DataFrame) -> DataFrame:
    """unit_id and cluster 1..K in the order of labels (column label), which are rounded as x + 0.5 cut off to zero."""
    cut = (F.col("label").cast("double") + 0.5).cast("int")
    ranked = labels.select(cut.alias("cut")).distinct().select("cut", F.dense_rank().over(Window.orderBy("cut")).alias("cluster"))
    return labels.select("unit_id", cut.alias("cut")).join(ranked, "cut").select("unit_id", "cluster")


def order_by_size(partition: DataFrame) -> DataFrame:
    """The same clusters, numbered from the largest; equal ones by their old label."""
    sizes = cluster_sizes(partition).select("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).alias("new"))
    return partition.join(sizes, "cluster").select("unit_id", F.col("new").alias("cluster"))
