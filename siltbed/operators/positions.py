"""Global row numbers and running sums without a single-partition window: range partitioning, then
each partition's count and sum (one row each), then the rows once more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.session import checkpointed, partitions


def with_positions(df: DataFrame, order: list[Column], size: Column | None = None) -> DataFrame:
    """df with `pos`, the row's place from 0, and `off`, the sum of `size` over the rows before it.
    Rows that are equal in all order columns take their places in any order."""
    sized = df.withColumn("_size", F.lit(0).cast("long") if size is None else size.cast("long"))
    rows = checkpointed(sized.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order))

    def total(it):
        n = s = 0
        for batch in it:
            n += batch.num_rows
            s += int(np.sum(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([s], pa.int64())], ["part", "n", "s"])

    sums = sorted(rows.select("_size").mapInArrow(total, "part int, n long, s long").collect())
    base, n, s = {}, 0, 0
    for part, count, amount in sums:
        base[part] = (n, s)
        n, s = n + count, s + amount
    names = df.columns

    def number(it):
        pos, off = base.get(TaskContext.get().partitionId(), (0, 0))
        for batch in it:
            v = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(v, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(pos, pos + len(v)), pa.int64()), pa.array(off + ends - v, pa.int64())], names=[*names, "pos", "off"])
            pos, off = pos + len(v), off + (int(ends[-1]) if len(v) else 0)

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(number, StructType([*df.schema.fields, StructField("pos", LongType()), StructField("off", LongType())]))
