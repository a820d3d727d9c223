"""Events that come in bursts: one for each burst of a key, for tables and streams alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def debounced(events: DataFrame, keys: list[str], ts: str, order: str, gap: str) -> DataFrame:
    """One row for each burst: the first event's columns, with n, first_ts and last_ts.

    A burst of a key ends when nothing comes within ``gap``; the first event, by time and ``order``, stands
    for it.  On a stream with a watermark a burst is emitted once the watermark has passed its end;
    events that are later than the watermark are left out, as Spark does.
    """
    rest = [c for c in events.columns if c not in keys]
    d = events.groupBy(*keys, F.session_window(ts, gap).alias("_burst"))
    d = d.agg(F.min_by(F.struct(*rest), F.struct(ts, order)).alias("_r"), F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return d.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), "n", "first_ts", "last_ts")


def bursts(events: DataFrame, keys: list[str], ts: str, order: str, gap: str) -> DataFrame:
    """The rows of ``debounced`` for a table in which few keys may have most events.

    Events are range-sorted by key and time, so a crowded key fills several ranges; a range tells where
    bursts begin within it, and of each range and key one row with its ends is joined back for what lies
    across.  Events without a time are left out; null is a key like others.
    """
    rest = [c for c in events.columns if c not in keys]
    by = [*keys, ts, order, "_row"]
    d = events.where(F.col(ts).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    d = written(d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()), "events")
    w = Window.partitionBy("_range", *keys).orderBy(ts, order, "_row")
    apart = lambda now, before: F.col(now) > F.col(before) + F.expr(f"INTERVAL {gap}")
    d = d.withColumn("_prev", F.lag(ts).over(w)).withColumn("_inner", F.coalesce(apart(ts, "_prev"), F.lit(False)).cast("long"))
    d = d.withColumn("_inner_before", F.sum("_inner").over(w))
    ends = d.groupBy("_range", *keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_inner").alias("_begun"))
    # a key has no more rows here than the sort has ranges
    across = Window.partitionBy(*keys).orderBy("_range")
    ends = ends.withColumn("_until", F.lag("_last").over(across)).withColumn("_new", F.coalesce(apart("_first", "_until"), F.lit(True)).cast("long"))
    ends = ends.withColumn("_offset", F.sum(F.col("_begun") + F.col("_new")).over(across) - F.col("_begun"))
    ends = ends.select(F.col("_range").alias("_at"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_offset")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_range") == F.col("_at"))
    d = d.join(ends, same).withColumn("_burst", F.col("_offset") + F.col("_inner_before"))
    d = d.groupBy(*keys, "_burst").agg(F.min_by(F.struct(*rest), F.struct(ts, order)).alias("_r"), F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return d.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), "n", "first_ts", "last_ts")
