"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Links that one task contracts; more links are dealt over several tasks.
LINKS_PER_TASK = 200_000
ROOTS = "node long, root long"


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the least node it reaches through them; by min-label hooking."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return nodes, nodes[label]


def _contracted(batches):
    rows = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if rows:
        node, root = contract(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def connected(links: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b), root the least node reachable.

    Each round contracts the links of a task to stars.  While there are too many for one task, large
    and small stars (two min-aggregations) bring links of a component together; the rounds are
    logarithmic in a component's diameter and each writes its links into the shared folder.
    """
    pairs = links.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("root"))
    pairs = written(pairs, "links")
    n = pairs.count()
    while n > links_per_task:
        tasks = -(-n // links_per_task)
        # links of one least end meet in a task, but no more of them than a task takes
        ends = pairs.withColumn("end", F.least("node", "root"))
        large_ends = ends.groupBy("end").agg(F.ceil(F.count("*") / links_per_task).alias("pieces")).where("pieces > 1")
        salted = ends.join(large_ends, "end", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("node", "root"), F.col("pieces")), F.lit(0)))
        local = salted.repartition(tasks, "end", "piece").select("node", "root").mapInArrow(_contracted, ROOTS).where("node <> root")
        both = local.unionByName(local.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        large = written(large.where("node <> root"), "stars")
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("m").alias("root")), F.struct("node", F.col("m").alias("root")))).alias("e")).select("e.*").where("node <> root").distinct()
        new = written(small, "links")
        count = new.count()
        settled = count == n and not new.join(pairs, ["node", "root"], "left_anti").limit(1).count()
        pairs, n = new, count
        if settled:
            roots = pairs.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
            return written(pairs.unionByName(roots), "roots")
    return written(pairs.repartition(1).mapInArrow(_contracted, ROOTS), "roots")
