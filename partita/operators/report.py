"""What a scored partition says: classes of sites, characteristic values, annotated units, a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.counts import cluster_sizes
from partita.operators.encode import Dataset, decode
from partita.operators.ranks import ranked


def site_classes(states: DataFrame, data: Dataset) -> DataFrame:
    """pos, cluster, class of every site: 4 where a value is characteristic, 3 elsewhere on such a site, else 2 or 1."""
    known = states.join(data.attributes.select("attr_id", "pos"), "attr_id").groupBy("pos", "cluster")
    flags = known.agg(F.bool_or(F.col("state") == 4).alias("own"), F.bool_or(F.col("state") == 2).alias("weak"))
    site = Window.partitionBy("pos")
    kind = F.when(F.col("own"), 4).when(F.max("own").over(site), 3).when(F.max("weak").over(site), 2).otherwise(1)
    grid = data.sites.select("pos").crossJoin(states.select("cluster").distinct())
    return grid.join(flags.select("pos", "cluster", kind.alias("kind")), ["pos", "cluster"], "left").select("pos", "cluster", F.coalesce("kind", F.lit(1)).alias("class"))


def shown(value: Column) -> Column:
    """A characteristic value as reports write it: in capitals, and "-" as "+"."""
    return F.when(value == "-", "+").otherwise(F.upper(value))


def characteristic_values(states: DataFrame, data: Dataset) -> DataFrame:
    """pos, cluster and value of every characteristic value."""
    return states.where(F.col("state") == 4).join(data.attributes.select("attr_id", "pos", "value"), "attr_id").select("pos", "cluster", shown(F.col("value")).alias("value"))


def characteristic_table(states: DataFrame, data: Dataset, clusters: list[int]) -> DataFrame:
    """A row for each site with characteristic values and a column for each cluster; several are joined in order."""
    values = characteristic_values(states, data)
    return values.groupBy("pos").pivot("cluster", clusters).agg(F.array_join(F.array_sort(F.collect_set("value")), ","))


def annotated_units(states: DataFrame, data: Dataset, partition: DataFrame) -> DataFrame:
    """cluster, place, line: a cluster's header (place 0) and a line for each of its units.

    A header has, by site, its characteristic value, or how many there are. In a unit's line characteristic values are
    capitals, others small, missing ones and those of sites with one value blank; cells are as wide as the site's widest
    and the line ends in `` ; uid``.
    """
    own = characteristic_values(states, data).groupBy("cluster", "pos").agg(F.array_sort(F.collect_set("value")).alias("values"))
    cells = decode(data).join(partition, "unit_id").join(own, ["cluster", "pos"], "left")
    special = F.coalesce(F.array_contains("values", shown(F.col("value"))), F.lit(False))
    texts = cells.select("cluster", "unit_id", "pos", F.when(special, shown(F.col("value"))).otherwise(F.lower("value")).alias("text"))
    heads = partition.select("cluster").distinct().crossJoin(data.sites.select("pos")).join(own, ["cluster", "pos"], "left")
    count = F.coalesce(F.size("values"), F.lit(0))
    heads = heads.select("cluster", F.lit(None).cast("long").alias("unit_id"), "pos", F.when(count == 1, F.element_at("values", 1)).when(count > 1, count.cast("string")).otherwise("").alias("text"))
    every = texts.unionByName(heads)
    widths = every.groupBy("cluster", "pos").agg(F.greatest(F.max(F.length("text")), F.lit(1)).alias("width"))
    padded = every.join(widths, ["cluster", "pos"]).select("cluster", "unit_id", "pos", F.expr("lpad(text, width, ' ')").alias("text"))
    rows = padded.groupBy("cluster", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("line"))
    named = ranked(rows.join(data.units, "unit_id", "left").select("cluster", "unit_id", "uid", "line"), ["cluster", "unit_id"], "rank")
    heads_at = named.where(F.col("unit_id").isNull()).select("cluster", F.col("rank").alias("first"))  # a row for each cluster
    line = F.concat("line", F.coalesce(F.concat(F.lit(" ; "), "uid"), F.lit("")))
    return named.join(heads_at, "cluster").select("cluster", (F.col("rank") - F.col("first")).cast("int").alias("place"), line.alias("line"))


def cluster_summary(states: DataFrame, partition: DataFrame) -> DataFrame:
    """cluster, n and how many attributes are in each state there."""
    counts = states.groupBy("cluster").agg(*[F.sum((F.col("state") == s).cast("long")).alias(f"state{s}") for s in range(1, 5)])
    return cluster_sizes(partition).join(counts, "cluster").select("cluster", "n", "state1", "state2", "state3", "state4")


def write_report(path: str, *, partition: DataFrame, score: DataFrame, states: DataFrame, data: Dataset, what: int = 1) -> None:
    """Level 1 writes partition and score, 2 also site classes, 3 characteristic values, 4 annotated units."""
    parts = {"partition": partition.orderBy("unit_id"), "score": score}
    if what >= 2:
        parts["site_classes"] = site_classes(states, data).orderBy("pos", "cluster")
    if what >= 3:
        parts["characteristic_values"] = characteristic_values(states, data).orderBy("pos", "cluster", "value")
    if what >= 4:
        parts["annotated_units"] = annotated_units(states, data, partition).orderBy("cluster", "place")
    for name, df in parts.items():
        # Lines are padded, and blanks at their ends are kept.
        df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}")
