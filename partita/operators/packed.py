"""Units packed with the places of their ones, as Spark rows and as arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators.encode import Dataset

ROWS = 1024


def pack(data: Dataset, partition: DataFrame, ids: np.ndarray) -> DataFrame:
    """unit_id, cluster (from 0) and the places of a unit's ones among ``ids``, in order."""
    kept = data.ones.sparkSession.sparkContext.broadcast(ids)
    gathered = data.ones.groupBy("unit_id").agg(F.array_sort(F.collect_list("attr_id")).alias("attrs"))
    rows = partition.join(gathered, "unit_id", "left").select(F.col("unit_id").cast("long").alias("unit_id"), F.col("cluster").cast("int").alias("cluster"), F.coalesce("attrs", F.expr("cast(array() as array<int>)")).cast("array<long>").alias("attrs"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            attrs = batch.column("attrs")
            at = np.searchsorted(kept.value, attrs.flatten().to_numpy()).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(attrs).to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("unit_id"), batch.column("cluster"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], ["unit_id", "cluster", "at"])

    return rows.mapInArrow(place, "unit_id long, cluster int, at array<int>")


class Units:
    """Some packed units as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        take = lambda c: (x.combine_chunks() if isinstance(x := batch.column(c), pa.ChunkedArray) else x)
        self.ids, self.cluster, lists = take("unit_id").to_numpy(zero_copy_only=False), take("cluster").to_numpy(zero_copy_only=False), take("at")
        self.flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.ids)), self.lengths)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over each unit's ones of a value (or row of values) for each one."""
        out = np.zeros((len(self.ids), *values.shape[1:]))
        some = self.lengths > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.starts[some], axis=0)
        return out

    def dense(self, m: int) -> np.ndarray:
        y = np.zeros((len(self.ids), m))
        y[self.row, self.flat] = 1
        return y


def blocks(batches: Iterator[pa.RecordBatch], kind: type[Units] = Units) -> Iterator[Units]:
    """The units of some batches, ``ROWS`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield kind(batch.slice(at, ROWS))
