"""Fusion and everything that happens to a ranked list.  Ties always go by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0
BLEND = (0.575, 0.425)


def ranked(hits: DataFrame, rank: str, limit: int = 200) -> DataFrame:
    """(id, score, <rank>) of the best ``limit`` hits, ranks from 1.  The limit comes before the
    window, so that no more than ``limit`` rows meet in one task."""
    top = hits.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def weighted_rrf(vector: DataFrame, keyword: DataFrame, alpha: float | Column, k: float = RRF_K, beta: float | Column | None = None) -> DataFrame:
    """alpha / (k + vector rank) + (1 - alpha) / (k + keyword rank); full outer on id."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    b = (1 - a) if beta is None else (F.lit(beta) if isinstance(beta, float) else beta)
    v = vector.select("id", F.col("score").alias("vector_score"), "vector_rank")
    f = keyword.select("id", F.col("score").alias("keyword_score"), "keyword_rank")
    both = v.join(f, "id", "full_outer")
    part = lambda w, rank: F.coalesce(w / (k + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", part(a, "vector_rank") + part(b, "keyword_rank"))


def rrf(vector: DataFrame, keyword: DataFrame, k: float = RRF_K) -> DataFrame:
    return weighted_rrf(vector, keyword, 1.0, k, 1.0)


def vector_only(vector: DataFrame) -> DataFrame:
    """A ranked vector list in the shape of a fused one."""
    return vector.select("id", F.col("score").alias("vector_score"), "vector_rank", F.lit(None).cast("double").alias("keyword_score"), F.lit(None).cast("int").alias("keyword_rank"), "score")


def blend(rows: DataFrame, raw: str = "raw", fused: str = "score") -> DataFrame:
    """Reranked rows: sigmoid of the raw score and the fused score on the scale of its range.

    For the few rows that are reranked; extremes come from one aggregation, not a window.
    """
    ends = rows.agg(F.min(fused).alias("_low"), F.max(fused).alias("_high"))
    scaled = (F.col(fused) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-4))
    return rows.crossJoin(F.broadcast(ends)).withColumn("blended", BLEND[0] / (1 + F.exp(-F.col(raw))) + BLEND[1] * scaled).drop("_low", "_high")  # one row of extremes


def dedup_best(rows: DataFrame, keys: list[str], score: str = "score", order: str = "id") -> DataFrame:
    """The best row of each key, the first in ``order`` among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a partial aggregation instead of a window."""
    names = rows.columns
    first = rows.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("_r"))
    return first.select(*(F.col(f"_r.{n}").alias(n) for n in names))


def per_file_cap(rows: DataFrame, n: int, path: str = "path", score: str = "score", order: str = "id") -> DataFrame:
    """At most n rows of each path; adds file_score, the best of the path."""
    w = Window.partitionBy(path)
    capped = rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc(score), order))).where(F.col("_n") <= n)
    return capped.withColumn("file_score", F.max(score).over(w)).drop("_n")


def normal_path(path: Column | str) -> Column:
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\A(?:\./)+", "")


def path_prefix(rows: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    while prefix.startswith("./"):
        prefix = prefix[2:]
    return rows.where(normal_path(path).startswith(prefix))


def path_contains(rows: DataFrame, part: str, path: str = "path") -> DataFrame:
    return rows.where(F.col(path).contains(part))


def compact(rows: DataFrame, path: str = "path", rank: str = "rank") -> DataFrame:
    """The distinct paths with their best rank."""
    return rows.groupBy(path).agg(F.min(rank).alias("best_rank"))


def file_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """All chunks of a file, in order, with score 1."""
    while path.startswith("./"):
        path = path[2:]
    return chunks.where(normal_path("path") == path).withColumn("score", F.lit(1.0)).orderBy("start_line", "chunk_id")


def with_original(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds the first row (its ``order``) with the same key, null for that row itself.

    First rows are found by a partial aggregation; the join back is one that Spark can split where a key
    has many rows.
    """
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    d = rows.join(first, key, "left")
    return d.withColumn(name, F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_first")


def hydrated(top: DataFrame, rows: DataFrame, defaults: dict[str, str], key: str = "id") -> DataFrame:
    """Ranked rows with what is shown of them; rows that are not there any more keep their rank, with
    ``defaults``.  For a list whose length a limit bounds: it is broadcast, the rows are not shuffled."""
    keys = top.select(key)
    found = rows.join(F.broadcast(keys), key, "left_semi")
    d = top.join(found, key, "left")
    return d.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in d.columns))
