"""Snapshots against snapshots: what is new, changed or gone; deletes, upserts, caches, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import with_running_sum


def change_detect(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, old_hash, new_hash): new, deleted, changed or unchanged.

    Unchanged files have the same time and size, or else the same content.
    """
    a = old.select("path", F.col("hash").alias("old_hash"), F.col("mtime").alias("_om"), F.col("size").alias("_os"))
    b = new.select("path", F.col("hash").alias("new_hash"), F.col("mtime").alias("_nm"), F.col("size").alias("_ns"))
    same = ((F.col("_om") == F.col("_nm")) & (F.col("_os") == F.col("_ns"))) | (F.col("old_hash") == F.col("new_hash"))
    status = F.when(F.col("_om").isNull(), "new").when(F.col("_nm").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def upsert(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return without(rows, fresh, key).unionByName(fresh, allowMissingColumns=True)


def with_ids(rows: DataFrame, order: list[str], first: int = 0, name: str = "chunk_id") -> DataFrame:
    """Dense ids in ``order`` from ``first`` on.

    Ranges are sorted in parallel and counted; only the counts meet, so no task sees all rows.
    """
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    counts = d.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    d = d.join(F.broadcast(before.select("_p", "_b")), "_p")
    return d.withColumn(name, (F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_b") + (first - 1)).cast("long")).drop("_p", "_b")


def cache_split(chunks: DataFrame, cache: DataFrame, key: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Chunks with their cached embedding, and the distinct chunks by hash still to embed."""
    known = chunks.join(cache.select(key, "embedding"), key)
    misses = chunks.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return known, misses


def event_dedupe(events: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) event of each key."""
    names = events.columns
    pick = (F.max_by if last else F.min_by)(F.struct(*names), F.struct(*order))
    return events.groupBy(key).agg(pick.alias("_r")).select(*(F.col(f"_r.{n}").alias(n) for n in names))


def ids_by_path(chunks: DataFrame) -> DataFrame:
    """(path, chunk_ids, chunk_count) of each file; a list holds one file's chunks."""
    return chunks.groupBy("path").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.count("*").cast("int").alias("chunk_count"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by a partial aggregation."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r")).select(*(F.col(f"_r.{n}").alias(n) for n in names))


def within_budget(rows: DataFrame, used: str, weight: str, key: str, budget: int) -> DataFrame:
    """The rows that stay when the least recently used go, one after another, until the weights of the
    others sum to ``budget`` at most; of rows used at one time the lower keys stay.

    Sums run over ranges of the order; no task sees all rows.
    """
    d = with_running_sum(rows, [F.desc_nulls_last(used), F.col(key)], weight, "_before")
    return d.where(F.col("_before") + F.coalesce(F.col(weight).cast("long"), F.lit(0)) <= budget).drop("_before")
