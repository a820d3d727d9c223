"""Running sums over a whole table in one order, without a task that sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import written


def with_running_sum(rows: DataFrame, order: list[Column | str], value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` (whole numbers, null as 0) over all rows that come earlier in ``order``.

    Rows are range-sorted; a partition adds up as it goes, is written with its number, and the sums of
    the partitions before it are joined back: one row a partition.  Among rows that are equal in
    ``order`` any may come first; they may fill several partitions.
    """
    names = rows.columns
    keys = [F.col(x) if isinstance(x, str) else x for x in order]
    d = rows.withColumn("_v", F.coalesce(F.col(value).cast("long"), F.lit(0))).withColumn("_row", F.monotonically_increasing_id())
    d = d.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row").withColumn("_part", F.spark_partition_id())
    at = d.columns.index("_v")
    schema = StructType([*d.schema.fields, StructField("_before", LongType())])

    def run(batches):
        carried = 0
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False)
            until = np.cumsum(v) + carried
            carried = int(until[-1]) if len(v) else carried
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(until - v, pa.int64())], names=[*b.schema.names, "_before"])

    d = written(d.mapInArrow(run, schema), "running")
    sums = d.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    begun = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))  # a row a partition
    return d.join(F.broadcast(begun), "_part").select(*names, (F.col("_before") + F.col("_begin")).alias(name))  # a row a partition

