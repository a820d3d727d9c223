"""Counts and ratios about stores, chunks, caches and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def store_stats(chunks: DataFrame, path: str = "path") -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct(path).alias("total_files"))


def combined_stats(chunks: DataFrame, db: str = "db", path: str = "path") -> DataFrame:
    """One row: sums over databases, and the share of each known kind of database."""
    per = chunks.groupBy(db).agg(F.count("*").alias("c"), F.count_distinct(path).alias("f"))
    of = lambda name, x: F.coalesce(F.sum(F.when(F.col(db) == name, F.col(x))), F.lit(0)).alias(f"{name}_{'chunks' if x == 'c' else 'files'}")
    return per.agg(F.sum("c").alias("total_chunks"), F.sum("f").alias("total_files"), F.bool_or(F.col("c") > 0).alias("indexed"), of("local", "c"), of("global", "c"), of("local", "f"), of("global", "f"))


def dedup_stats(chunks: DataFrame, key: str = "hash") -> DataFrame:
    total, unique = F.count("*"), F.count_distinct(key)
    return chunks.agg(total.alias("total"), unique.alias("unique"), (total - unique).alias("duplicates"), F.round(ratio(total - unique, total), 6).alias("ratio"))


def histogram(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    d = rows.groupBy(column).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), column).limit(limit) if limit else d


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    n = F.octet_length(text).cast("long")
    return rows.agg(F.min(n).alias("min_bytes"), F.max(n).alias("max_bytes"), F.sum(n).alias("sum_bytes"), F.round(F.avg(n), 6).alias("avg_bytes"))


def embed_stats(total: int, embedded: int, cached: int, millis: float) -> dict[str, float]:
    over = lambda a, b: a / b if b else 0.0
    return {"hit_rate": over(cached, total), "success_rate": over(embedded, total), "chunks_per_second": over(embedded, millis / 1000)}


def retrieval_eval(answers: DataFrame) -> DataFrame:
    """answers: query, expected, found, score, is_negative; top-1 accuracy and mean scores."""
    ok = F.when(~F.col("is_negative"), F.col("found").contains(F.col("expected")).cast("int"))
    return answers.agg(F.round(F.avg(ok), 6).alias("accuracy"), F.round(F.avg(F.when(~F.col("is_negative"), F.col("score"))), 6).alias("avg_score"), F.round(F.avg(F.when(F.col("is_negative"), F.col("score"))), 6).alias("false_positive_score"))
