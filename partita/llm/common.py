"""What the corpus operators share: scratch tables, clean inputs and stable row hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.sources.scratch import shared_folder

#: Stands for a missing id: it sorts after every other one.
LAST_ID = 2**63 - 1

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/partita-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, and Spark knows its size."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` (long), ``text`` and the columns in ``keep``; any other column of ``df`` is left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def hash60(column: str) -> Column:
    """60 even bits of a value's text, the same in every engine that has MD5; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle width, which is set to suit the size of the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
