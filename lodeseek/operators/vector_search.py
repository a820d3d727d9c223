"""Nearest neighbours by cosine: exact, for one query or a batch, and approximate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Queries, and rows, of one block.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Scores that a task holds at a time.
SCORES = 1 << 18


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(id, cosine, score) of the k nearest; fails on vectors of another length."""
    q = F.array(*(F.lit(float(np.float32(x))) for x in query))
    near = V.cosine(V.checked(F.col(column), len(query)), q)
    d = vectors.select(F.col(id_col).alias("id"), near.alias("cosine"))
    return d.withColumn("score", V.score(F.col("cosine"))).orderBy(F.desc("cosine"), "id").limit(k)


def _blocks(batches, size: int, name: str):
    """Rows (id, vector) in blocks of ``size``: one row with all ids and one with all numbers."""
    for batch in batches:
        for s in range(0, batch.num_rows, size):
            part = batch.slice(s, size)
            vectors = part.column(1)
            if isinstance(vectors, pa.ChunkedArray):
                vectors = vectors.combine_chunks()
            lengths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
            if len(lengths) > 1 or vectors.flatten().null_count:
                raise ValueError(f"{name}: vectors of unlike lengths or with missing numbers: {lengths.tolist()}")
            m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([int(lengths[0])], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["ids", "dimensions", "numbers"])


def _first(far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least, of equal ones the least ids; only what reaches the k-th is sorted."""
    if k < len(far):
        within = np.flatnonzero(~(far > np.partition(far, k - 1)[k - 1]))
        return within[np.lexsort((ids[within], far[within]))[:k]]
    return np.lexsort((ids, far))


def _nearest(batches, k: int):
    """Pairs of a block of rows and one of queries: each query's k nearest, by matrix products of at
    most SCORES numbers."""
    for batch in batches:
        for r in range(batch.num_rows):
            width, query_width = (batch.column(c)[r].as_py() for c in (1, 4))
            if width != query_width:
                raise ValueError(f"vectors have {width} numbers, queries {query_width}")
            ids, queries = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (0, 3))
            # the numbers stay where the batch has them
            numbers, asked = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float32).reshape(-1, width) for c in (2, 5))
            m = numbers.astype(np.float64)
            lengths, strip = np.linalg.norm(m, axis=1), max(1, SCORES // len(ids))
            for s in range(0, len(queries), strip):
                q = asked[s : s + strip].astype(np.float64)
                scale = np.outer(np.linalg.norm(q, axis=1), lengths)
                near = np.divide(q @ m.T, scale, out=np.zeros_like(scale), where=scale > 0)
                order = np.array([_first(-x, ids, k) for x in near])
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[s : s + strip], n)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(near, order, 1).ravel())], names=["query_id", "id", "cosine"])


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(query_id, id, cosine, score, rank) for every query (query_id, embedding).

    Rows and queries are put into blocks, every block of queries meets every block of rows, and each
    meeting yields k hits a query; nothing passes the driver.  Rows and queries without a vector have
    no hits; vectors of unlike lengths are an error.
    """
    schema = "ids array<long>, dimensions int, numbers binary"
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    # blocks are shuffled, or every meeting of partitions would make those of both anew, each by a worker of its own
    rows = rows.mapInArrow(lambda batches: _blocks(batches, ROW_BLOCK, "rows"), schema).repartition(F.col("ids")[0])
    # few partitions, or there would be many small blocks
    asked = asked.coalesce(8).mapInArrow(lambda batches: _blocks(batches, QUERY_BLOCK, "queries"), schema).repartition(F.col("ids")[0]).toDF("query_ids", "query_dimensions", "query_numbers")
    # a stated set of queries against all rows, block by block
    every = rows.crossJoin(asked).mapInArrow(lambda batches: _nearest(batches, k), "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", V.score(F.col("cosine")))


def approximate_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", column: str = "embedding", tables: int = 8, width: float = 2.0, over: int = 20) -> DataFrame:
    """Random-projection buckets with a fixed seed propose k * over rows, which are scored exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select(F.col(id_col).alias("id"), F.col(column).alias(column), array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", numHashTables=tables, bucketLength=width, seed=42).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), k * over)
    return top_k(near.select("id", column), query, k, "id", column)
