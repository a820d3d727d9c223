"""Stored approximate nearest neighbours: vectors lie in the cells of landmark vectors, a folder each.

Landmarks are vectors of the table itself, those whose ids have the least hashes: a sample of at most
``MOST_CELLS`` rows, fitted once, whatever the table's size.  Every row is written to the cell of its
nearest landmark; a search reads the cells of the landmarks nearest to the query and scores their rows
exactly.  More rows need no new fit: they go to the cells that are there.

How many cells a search reads is measured, not guessed: ``tuned_probes`` asks for the true neighbours of
``ASKED`` rows and takes the number of cells that holds ``RECALL`` of them.  Vectors in groups need few;
of vectors that lie alike in all directions most cells hold some neighbour, whatever the partition.

A crowded cell is written by several tasks, which range over cell and id; rows without a vector have no
cell and no hits; vectors of another length than the landmarks' are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import vectors as V
from .vector_search import QUERY_BLOCK, ROW_BLOCK, _nearest, batch_top_k, top_k

#: Cells of the largest tables.
MOST_CELLS = 4096
#: Rows whose neighbours are asked for, neighbours of each, and the share of them to be found.
ASKED, NEIGHBOURS, RECALL = 64, 10, 0.95


def cell_count(rows: int) -> int:
    """About as many cells as a cell has rows."""
    return max(1, min(MOST_CELLS, math.isqrt(rows)))


def landmarks(vectors: DataFrame, id_col: str = "id", column: str = "embedding", cells: int | None = None) -> list[list[float]]:
    """The distinct vectors among the rows with the least hashes of their ids, in order of the hashes."""
    rows = vectors.where(F.col(column).isNotNull())
    cells = cell_count(rows.count()) if cells is None else min(cells, MOST_CELLS)
    sample = rows.select(F.sha2(F.col(id_col).cast("string"), 256).alias("h"), F.col(column).cast("array<float>").alias("v")).orderBy("h", "v").limit(cells)
    return [list(v) for v in dict.fromkeys(tuple(r.v) for r in sample.collect())]  # MOST_CELLS rows at most


def _directions(marks: list[list[float]]) -> np.ndarray:
    m = np.array(marks, np.float32).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _order(vectors, directions: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, the lower number first among equals."""
    v = np.stack([np.asarray(x, np.float32) for x in vectors]).astype(np.float64)
    near = v @ directions.T
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def with_cells(vectors: DataFrame, marks: list[list[float]], column: str = "embedding", name: str = "cell") -> DataFrame:
    """Rows that have a vector, with the cell of its nearest landmark."""
    directions = _directions(marks)

    @pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_order(v, directions, 1)[:, 0].astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    return vectors.where(F.col(column).isNotNull()).withColumn(name, cell(F.col(column)))


def write(vectors: DataFrame, path: str, id_col: str = "id", mode: str = "errorifexists") -> None:
    """Rows with their cell as a folder a cell."""
    vectors.repartitionByRange("cell", id_col).sortWithinPartitions("cell", id_col).write.mode(mode).partitionBy("cell").parquet(path)


def nearest_cells(query: list[float], marks: list[list[float]], probes: int) -> list[int]:
    return _order([query], _directions(marks), probes)[0].tolist()


def tuned_probes(vectors: DataFrame, marks: list[list[float]], id_col: str = "id", column: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """The cells to read for a share of the true neighbours of ASKED rows; one pass over all rows.

    The driver gets the neighbours of these rows only.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.col(column).cast("array<float>").alias("embedding"))
    asked = rows.withColumn("h", F.sha2(F.concat(F.lit("q"), F.col("id").cast("string")), 256)).orderBy("h", "embedding").limit(ASKED).collect()
    if not asked:
        return 1
    queries = vectors.sparkSession.createDataFrame([(i, r.embedding) for i, r in enumerate(asked)], "query_id long, embedding array<float>")
    near = batch_top_k(rows, queries, k).select("query_id", "id")
    found = with_cells(rows.join(F.broadcast(near), "id"), marks).select("query_id", "cell").collect()  # ASKED * k rows
    order = _order([r.embedding for r in asked], _directions(marks), len(marks))
    places = sorted(int(np.flatnonzero(order[r.query_id] == r.cell)[0]) + 1 for r in found)
    return places[math.ceil(recall * len(places)) - 1]


def search(stored: DataFrame, marks: list[list[float]], query: list[float], k: int, probes: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(id, cosine, score) of the k nearest rows of the probed cells; other cells' files are not read."""
    return top_k(stored.where(F.col("cell").isin(nearest_cells(query, marks, probes))), query, k, id_col, column)


def _cell_blocks(batches, size: int):
    """Rows (cell, id, vector) in blocks of one cell: one row with all ids and one with all numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(cells, kind="stable")
        begins = np.concatenate([[0], np.flatnonzero(np.diff(cells[order])) + 1, [len(order)]])
        for a, z in zip(begins, begins[1:]):
            for s in range(a, z, size):
                part = batch.take(pa.array(order[s : min(s + size, z)]))
                lengths = np.unique(part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                if len(lengths) > 1:
                    raise ValueError(f"vectors of unlike lengths: {lengths.tolist()}")
                m = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(cells[order[s]])], pa.int32()), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([int(lengths[0])], pa.int32()), pa.array([m.tobytes()], pa.binary())],
                    names=["cell", "ids", "dimensions", "numbers"],
                )


def batch_search(stored: DataFrame, marks: list[list[float]], queries: DataFrame, k: int, probes: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(query_id, id, cosine, score, rank) for every query (query_id, embedding) that has a vector.

    Queries go to their cells and meet the rows there in blocks, one matrix product a meeting.  Blocks
    are few and large, so Spark splits a crowded cell.
    """
    directions = _directions(marks)

    @pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(_order(v, directions, probes).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    schema = "cell int, ids array<long>, dimensions int, numbers binary"
    asked = queries.where("embedding IS NOT NULL").select(F.explode(cells("embedding")).alias("cell"), F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    # the queries of a cell together, else there would be a block for each of them
    asked = asked.repartition("cell").mapInArrow(lambda batches: _cell_blocks(batches, QUERY_BLOCK), schema).toDF("cell", "query_ids", "query_dimensions", "query_numbers")
    rows = stored.select("cell", F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v")).mapInArrow(lambda batches: _cell_blocks(batches, ROW_BLOCK), schema)
    met = rows.join(asked, "cell").select("ids", "dimensions", "numbers", "query_ids", "query_dimensions", "query_numbers")
    near = met.mapInArrow(lambda batches: _nearest(batches, k), "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", V.score(F.col("cosine")))
