"""Tables between the jobs of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="partita-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read again, so that lineage ends."""
    return _write(df)[0]


class Tables:
    """Tables of an iteration, of which the last ``keep`` are there; older ones are removed once the next is written."""

    def __init__(self, keep: int = 2):
        self.keep, self.spark, self.paths = keep, None, []

    def written(self, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        made, path = _write(df)
        self.paths.append(path)
        self._drop(len(self.paths) - self.keep)
        return made

    def drop(self) -> None:
        """Removes all of them; nothing that reads them may be used any more."""
        self._drop(len(self.paths))

    def _drop(self, n: int) -> None:
        for path in self.paths[: max(0, n)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        del self.paths[: max(0, n)]
