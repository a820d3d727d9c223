"""Watching a tree: timed snapshots compared with the index, or a stream of change records.

A file source would miss rewritten and deleted files, so it is not used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes, events
from ..plans.index import Index
from ..sources import files as S
from ..sources import ignore
from ..sources import languages as L
from ..storage import written

CHANGES = "seq long, op string, path string, new_path string"


def watched(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """Paths that a watcher does not ignore."""
    rules = [*patterns, *L.WATCH_PATTERNS]
    return paths.where(~L.ignored(F.col(column), rules) & ~L.extension(F.col(column)).isin(L.WATCH_BINARY))


def settled(records: DataFrame, quiet: str, late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Change records of a stream (CHANGES and a time), one for each burst of a path: its first, once the
    path has been quiet."""
    return events.debounced(records.withWatermark(ts, late), ["path"], ts, "seq", quiet).select("seq", "op", "path", "new_path", ts)


def net_changes(records: DataFrame) -> DataFrame:
    """One change a path: the first kind seen wins; a rename is a delete and a create."""
    moved = records.where("op = 'renamed'")
    plain = records.where("op <> 'renamed'").select("seq", F.when(F.col("op") == "removed", "deleted").otherwise("modified").alias("op"), "path")
    every = plain.unionByName(moved.select("seq", F.lit("deleted").alias("op"), "path")).unionByName(moved.select("seq", F.lit("modified").alias("op"), F.col("new_path").alias("path")))
    return changes.event_dedupe(every, "path", ["seq", "op"])


#: Paths of a batch of records that are read by name; more are picked from a listing of the tree.
NAMED = 10_000


def recorded(index: Index, root: str, paths: DataFrame) -> DataFrame:
    """The readable files among some paths (path); no other file's content is read while they are few."""
    names = [r.path for r in paths.select("path").distinct().limit(NAMED + 1).collect()]
    if len(names) > NAMED:
        files = S.tree(index.spark, root).join(paths.select("path").distinct(), "path", "left_semi")
    else:
        files = S.named(index.spark, root, names)
    files = files.where(~L.in_excluded_dir(F.col("path")))
    rules = ignore.rules_above(index.spark, root, files)
    return S.readable(S.indexable(ignore.without_ignored(files, rules)))


def apply_changes(index: Index, root: str, records: DataFrame) -> None:
    """Brings the recorded paths up to date, and no other.  A path that is no longer there, or no longer
    to be indexed, is removed."""
    net = written(watched(net_changes(records), S.ignore_patterns(index.spark, root)).select("path", "op"), "changes")
    files = recorded(index, root, net.where("op = 'modified'"))
    here = net.where("op = 'modified'").join(files.select("path"), "path", "left_semi").select("path", F.lit("changed").alias("status"))
    index.apply(here.unionByName(net.join(here, "path", "left_anti").select("path", F.lit("deleted").alias("status"))), files)


def watch(spark: SparkSession, index: Index, root: str, every: str = "5 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """A query that compares the tree with the index at each tick."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out = ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda _, __: index.index(root))
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    return out.start()


def watch_records(records: DataFrame, index: Index, root: str, checkpoint: str) -> StreamingQuery:
    """A query that applies a stream of change records (CHANGES), batch by batch."""
    return records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: apply_changes(index, root, batch)).start()
