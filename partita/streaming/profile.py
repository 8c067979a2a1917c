"""Column profiles that stay up to date while records arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partita.operators.encode import profile_sites, value_counts


@dataclass
class Profile:
    """A profile kept below ``folder``: the counts of each batch under its number, and from time to time their sums.

    A batch that is run again after a failure replaces its own counts, so it counts once. After ``every`` batches all
    counts up to then are summed under the batch's number; later sums start from there.
    """

    folder: str
    every: int = 16

    def start(self, records: DataFrame, cells: Callable[[DataFrame], DataFrame], checkpoint: str, *, after: Callable[[int], None] | None = None) -> StreamingQuery:
        """Keeps the profile of a stream up to date; ``cells`` makes cells of some records, as for a batch.

        ``checkpoint`` lets the stream resume; ``after`` is called with a batch's number once its counts are written.
        """

        def merge(batch: DataFrame, number: int) -> None:
            value_counts(cells(batch)).write.mode("overwrite").parquet(f"{self.folder}/kind=batch/number={number}")
            if number % self.every == self.every - 1:
                self.counts(batch.sparkSession, number).write.mode("overwrite").parquet(f"{self.folder}/kind=sum/number={number}")
            if after is not None:
                after(number)

        return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()

    def counts(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """pos, value, n of all batches so far, or of those up to a number: the last sum before it and what came since."""
        rows = spark.read.option("basePath", self.folder).parquet(self.folder)
        if upto is not None:
            rows = rows.where((F.col("number") < upto) | ((F.col("number") == upto) & (F.col("kind") == "batch")))
        last = rows.where("kind = 'sum'").agg(F.max("number").alias("last")).first().last
        since = (F.col("kind") == "batch") & (F.col("number") > F.lit(-1 if last is None else last))
        summed = (F.col("kind") == "sum") & (F.col("number") == F.lit(-1 if last is None else last))
        return rows.where(since | summed).groupBy("pos", "value").agg(F.sum("n").alias("n"))

    def sites(self, spark: SparkSession) -> DataFrame:
        """The site table as it stands; equal to that of a batch over the same records."""
        return profile_sites(self.counts(spark))
