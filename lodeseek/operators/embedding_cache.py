"""A cache of vectors by content, bucketed by hash.

The cache is a bucketed table in files of its own: a join on the hash reads it bucket by bucket, and
only the chunks are shuffled, however large the cache is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from . import embedding
from .changes import latest, within_budget


class EmbeddingCache:
    """Vectors below ``path`` by the hash of the text that was embedded; one cache a model."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"embedding_cache_{uuid.uuid4().hex[:12]}"
        # names the files that may be there already; their names have their buckets
        spark.sql(f"CREATE TABLE {self.name} (key STRING, embedding ARRAY<FLOAT>, bytes BIGINT, used BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        """(key, embedding, bytes, used: seconds of the epoch), a row a use that wrote one."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    @staticmethod
    def text() -> Column:
        return T.prepare_text("context", "signature", "docstring", "content")

    def put(self, vectors: DataFrame) -> None:
        """Adds (key, embedding)."""
        n = F.col("key")
        rows = vectors.select(n, F.col("embedding").cast("array<float>"), (F.octet_length("key") + F.size("embedding") * 4).cast("long").alias("bytes"), F.unix_timestamp().alias("used"))
        self._write(rows, "append")

    def touch(self, keys: DataFrame) -> None:
        """Marks cached keys (key) as used now, by one more row each."""
        used = self.table().join(keys.select("key").distinct(), "key", "left_semi").select("key", "embedding").dropDuplicates(["key"])
        self.put(written(used, "used"))

    def evict(self, budget: int) -> None:
        """Keeps the vectors used last whose bytes sum to ``budget`` at most, a row each."""
        kept = within_budget(latest(self.table(), "key", "used"), "used", "bytes", "key", budget)
        self._write(written(kept, "kept"), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").mode(mode).option("path", self.path).saveAsTable(self.name)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows (with key) and their vector, null where the cache has none."""
        # one vector a key, whatever writers at once have put there: within buckets, without a shuffle
        known = self.table().groupBy("key").agg(F.first("embedding").alias("embedding"))
        return rows.join(known.hint("merge"), "key", "left")

    def embed(self, chunks: DataFrame, embedder: "embedding.Embedder") -> DataFrame:
        """Chunks with ``embedding``; texts that are cached are not embedded, others once each and put."""
        found = written(self.lookup(chunks.withColumn("key", F.sha2(self.text(), 256))), "cached")
        misses = found.where("embedding IS NULL").dropDuplicates(["key"])
        fresh = written(misses.select("key", embedder.column(self.text()).alias("embedding")), "embedded")
        self.put(fresh)
        known = found.where("embedding IS NOT NULL")
        return known.drop("key").unionByName(found.where("embedding IS NULL").drop("embedding").join(fresh, "key").select(*known.drop("key").columns))
