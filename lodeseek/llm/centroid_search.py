"""Centroid clustering of vectors by partial-distance search, in exact integers.

Assignment adds up squared differences a block of dimensions at a time, those of the highest variance
first.  The centroid that is nearest after the first block is measured whole; every other one is given
up as soon as its partial distance is strictly above the best so far, and only survivors finish all
dimensions.  A partial distance never shrinks, so the result is that of full distances, ties included.

A round is one pass over the table in Arrow batches; tasks hand on sums by centroid and dimension, and
the driver holds the centroids only.

Defined results: rows without a vector, of another length, or with null or non-finite components are
left out; repeated rows count each; equal hashes (repeated ids) are taken in order of the vectors; rows
with a null id take part but seed only after all others; with fewer than ``clusters`` vectors there are
as many centroids as vectors; an empty table gives an empty result; sums beyond a 64-bit integer come as
the largest one, while centroids are exact at any size; further columns stay out of the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import integer_vectors as I
from .storage import written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Dimensions of one step of a partial distance.
STEP = 8


def nearest(m: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of every row; ``order`` has the dimensions in which distances are summed."""
    m, c = I.alike(m[:, order], centroids[:, order])
    steps = [slice(s, s + STEP) for s in range(0, m.shape[1], STEP)]

    def part(rows, j, step):
        gap = m[rows, step] - c[j, step]
        return (gap * gap).sum(axis=-1)

    every = np.arange(len(m))
    first = np.stack([part(every, j, steps[0]) for j in range(len(c))], axis=1)
    cluster = first.argmin(axis=1)
    gap = m - c[cluster]
    best = (gap * gap).sum(axis=1)
    for j in range(len(c)):
        rows = every[(cluster != j) & (first[:, j] <= best)]
        so_far = first[rows, j]
        for step in steps[1:]:
            so_far = so_far + part(rows, j, step)
            alive = (so_far <= best[rows]).astype(bool)
            rows, so_far = rows[alive], so_far[alive]
        won = (so_far < best[rows]) | (j < cluster[rows])
        rows, so_far = rows[won.astype(bool)], so_far[won.astype(bool)]
        cluster[rows], best[rows] = j, so_far
    return cluster, best


def by_variance(kept: DataFrame, width: int, scale: int) -> np.ndarray:
    """The dimensions, those of the highest variance over all rows first."""

    def moments(batches):
        totals = np.zeros((2, width + 1), object)
        for b in batches:
            m = I.matrix(b.column(1), width, scale).astype(object)
            totals[0, :width] += m.sum(axis=0) if len(m) else 0
            totals[1, :width] += (m * m).sum(axis=0) if len(m) else 0
            totals[0, width] += len(m)
        yield I.partial_rows(totals)

    sums, squares = I.summed(kept.mapInArrow(moments, I.PARTIALS), (2, width + 1))
    spread = [sums[width] * squares[d] - sums[d] * sums[d] for d in range(width)]
    return np.array(sorted(range(width), key=lambda d: (-spread[d], d)), np.int64)


def fit(kept: DataFrame, centroids: np.ndarray, order: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """The centroids after ``rounds`` of assigning and moving."""
    width = centroids.shape[1]
    for _ in range(rounds):

        def sums(batches, centroids=centroids):
            totals = np.zeros((len(centroids), width + 1), object)
            for b in batches:
                m = I.matrix(b.column(1), width, scale)
                cluster, _ = nearest(m, centroids, order)
                for j in np.unique(cluster):
                    own = m[cluster == j]
                    totals[j, :width] += own.sum(axis=0).astype(object)
                    totals[j, width] += len(own)
            yield I.partial_rows(totals)

        new = I.moved(centroids, I.summed(kept.mapInArrow(sums, I.PARTIALS), (len(centroids), width + 1)))
        if np.array_equal(new, centroids):
            break  # further rounds would repeat this one
        centroids = new
    return centroids


def cluster(embeddings: DataFrame, id_col: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, and the centroids.

    The centroids start as the vectors whose ids, behind ``seed`` and a colon, have the least hashes.
    """
    kept = I.usable(embeddings.select(F.col(id_col).alias("id"), F.col(column).alias("v")), "v").where(F.size("v") == dimensions)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = kept.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).collect()
    schema = f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not seeds:
        return embeddings.sparkSession.createDataFrame([], schema), np.zeros((0, dimensions), np.int64)
    order = by_variance(kept, dimensions, scale)
    centroids = fit(kept, I.scaled(np.array([r.v for r in seeds]), scale), order, rounds, scale)

    def assign(batches):
        for b in batches:
            own, distance = nearest(I.matrix(b.column(1), dimensions, scale), centroids, order)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array([min(int(d), I.MOST) for d in distance], pa.int64())], names=["id", "cluster", "distance"])

    return kept.mapInArrow(assign, schema), centroids


def op11_centroid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if not len(centroids):
        return rows.selectExpr("id AS vec_id", "cluster", "distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    rows = written(rows, "assigned")
    inertia = [0] * len(centroids)
    for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect():  # a row a centroid
        inertia[r.cluster] = int(r.d)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.array(*map(F.lit, values))[F.col("cluster")]
    return rows.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of([min(x, I.MOST) for x in inertia]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia), I.MOST)).cast("long").alias("inertia"),
        of(hashes).alias("centroid_sha256"),
    )


def _round_sql(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT rid, c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (k.v[i] - e.v[i]) * (k.v[i] - e.v[i])))::BIGINT AS d FROM k, c{k} e) GROUP BY rid),
s{k} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{k} JOIN k USING (rid), (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY c, i) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(s.v, o.v) AS v FROM c{k} o LEFT JOIN s{k} s USING (c))"""


SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT {CLUSTERS})),
{",".join(_round_sql(k) for k in range(ROUNDS))},
f AS (SELECT rid, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
  SELECT rid, c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (k.v[i] - e.v[i]) * (k.v[i] - e.v[i])))::BIGINT AS d FROM k, c{ROUNDS} e) GROUP BY rid)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(e.v, ',')) AS centroid_sha256
FROM f JOIN k USING (rid) JOIN c{ROUNDS} e ON e.c = f.cluster
"""
