"""Numbers in order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.sources.scratch import written


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 by the columns ``order``, nulls first, in a column ``name``.

    Rows are dealt by range and sorted within partitions; a row's number is its place in its partition after the rows of
    the partitions before, of which only the sizes are gathered. Rows that agree in ``order`` come in any order.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    before, starts = 0, []
    for r in sorted(placed.groupBy("_part").count().collect()):  # a row for each partition
        starts.append((r._part, before))
        before += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _before long"))
    return placed.join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int" if before < 2**31 else "long")).drop("_part", "_at", "_before")
