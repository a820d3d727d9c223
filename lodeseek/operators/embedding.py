"""Embedding: models, a hashing embedder that needs none, batches by token budget, cached results."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from ..functions import vectors as V
from .changes import cache_split
from .running import with_running_sum

# Short name, full name, dimensions, quantised.
MODELS = [
    ("minilm-l6", "sentence-transformers/all-MiniLM-L6-v2", 384, False),
    ("minilm-l6-q", "sentence-transformers/all-MiniLM-L6-v2 (quantized)", 384, True),
    ("minilm-l12", "sentence-transformers/all-MiniLM-L12-v2", 384, False),
    ("minilm-l12-q", "sentence-transformers/all-MiniLM-L12-v2 (quantized)", 384, True),
    ("paraphrase-minilm", "sentence-transformers/paraphrase-MiniLM-L6-v2", 384, False),
    ("bge-small", "BAAI/bge-small-en-v1.5", 384, False),
    ("bge-small-q", "BAAI/bge-small-en-v1.5 (quantized)", 384, True),
    ("bge-base", "BAAI/bge-base-en-v1.5", 768, False),
    ("bge-large", "BAAI/bge-large-en-v1.5", 1024, False),
    ("nomic-v1", "nomic-ai/nomic-embed-text-v1", 768, False),
    ("nomic-v1.5", "nomic-ai/nomic-embed-text-v1.5", 768, False),
    ("nomic-v1.5-q", "nomic-ai/nomic-embed-text-v1.5 (quantized)", 768, True),
    ("jina-code", "jinaai/jina-embeddings-v2-base-code", 768, False),
    ("e5-multilingual", "intfloat/multilingual-e5-small", 384, False),
    ("mxbai-large", "mixedbread-ai/mxbai-embed-large-v1", 1024, False),
    ("modernbert-large", "lightonai/modernbert-embed-large", 1024, False),
]
DEFAULT_MODEL = "minilm-l6-q"
# Names of backends.
BACKENDS = {"fastembed": "onnx", "onnx": "onnx", "local": "onnx", "ollama": "http", "hashing": "hashing"}


@dataclass(frozen=True)
class Model:
    short: str
    name: str
    dimensions: int
    quantized: bool


def model(name: str = DEFAULT_MODEL) -> Model:
    for row in MODELS:
        if name.lower() in (row[0], row[1].lower()):
            return Model(*row)
    raise ValueError(f"unknown model {name!r}; known: {', '.join(r[0] for r in MODELS)}")


def token_budget(dimensions: int, batch_size: int | None = None) -> int:
    """Tokens of a batch: by the environment, by the batch size, or by the vector length."""
    if (own := os.environ.get("LODESEEK_TOKEN_BUDGET", "")).isdigit():
        return int(own)
    if batch_size:
        return max(1000, batch_size * 125)
    return max(1000, min(50_000, math.trunc(10_000 * 384 / dimensions)))


def token_budgets(dimensions: Column) -> Column:
    """``token_budget`` of vector lengths without an environment or a batch size."""
    return F.greatest(F.lit(1000), F.least(F.lit(50_000), F.floor(F.lit(10_000 * 384) / dimensions))).cast("long")


def batch_runs(counts: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int, int]]:
    """(tokens, first, open, size, batch) of each run of texts of equal tokens, in ascending order.

    first: texts before the run; open: texts of the run that still go to the batch begun before it;
    size: texts of each further batch; batch: the number of the batch begun before it.  A batch takes a
    text while the text's tokens times the batch's texts, itself included, stay within the budget.
    """
    out, first, batch, held = [], 0, 0, 0
    for tokens, n in counts:
        size = max(1, budget // tokens) if tokens else first + n + held + 1
        left = min(n, max(0, size - held) if held else size)
        out.append((tokens, first, left, size, batch))
        if n > left:
            batch, held = batch - (-(n - left) // size), (n - left - 1) % size + 1
        else:
            held += n
        first += n
    return out


def budget_batches(rows: DataFrame, text: str, budget: int, order: str) -> DataFrame:
    """Adds batch: texts by length, each batch as long as its longest text times its number stays
    within the budget, greedily over all rows.

    Texts of one token count fill batches of one size, so the breaks follow from how many texts have
    each count; counts above half the budget stand alone and need none.  The driver sees budget / 2
    counts at most, and a text finds its batch by its place in the order.  Null texts are empty.
    """
    tokens = F.coalesce(T.estimate_tokens(F.col(text)), F.lit(0))
    most = budget // 2 + 1
    d = rows.withColumn("_t", F.least(tokens, F.lit(most)))
    counts = sorted((r._t, r["count"]) for r in d.groupBy("_t").count().collect())  # budget / 2 + 2 rows at most
    runs = rows.sparkSession.createDataFrame([(t, *x) for t, *x in batch_runs([(t, n) for t, n in counts if t < most], budget)], "_t long, _first long, _open long, _size long, _batch long")
    alone = sum(n for t, n in counts if t < most)
    last = max((b + -(-(n - left) // size) for (_, _, left, size, b), (_, n) in zip(batch_runs([c for c in counts if c[0] < most], budget), counts)), default=-1)
    d = with_running_sum(d.withColumn("_one", F.lit(1)), [F.coalesce(F.octet_length(text), F.lit(0)), order], "_one", "_place")
    d = d.join(F.broadcast(runs), "_t", "left")  # a row a token count
    at = F.col("_place") - F.col("_first")
    within = F.when(at < F.col("_open"), F.col("_batch")).otherwise(F.col("_batch") + 1 + F.floor((at - F.col("_open")) / F.col("_size")))
    batch = F.when(F.col("_t") < most, within).otherwise(F.lit(last + 1) + F.col("_place") - alone)
    return d.withColumn("batch", batch.cast("long")).select(*rows.columns, "batch")


class Embedder(Protocol):
    """What embeds a column of texts; dimensions is the length of its vectors."""

    dimensions: int

    def column(self, text): ...


class HashingEmbedder:
    """Signed counts of hashed terms, scaled to length 1.  A stand-in without any claim to meaning."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def column(self, text):
        h = F.transform(T.tokens(text), lambda t: F.xxhash64(t))
        cells = F.transform(h, lambda x: F.struct(F.pmod(x, F.lit(self.dimensions)).cast("int").alias("c"), F.when(F.shiftright(x, 62) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
        grouped = F.aggregate(cells, F.array_repeat(F.lit(0.0), self.dimensions), lambda a, c: F.concat(F.slice(a, F.lit(1), c["c"]), F.array(F.element_at(a, c["c"] + 1) + c["s"]), F.slice(a, c["c"] + 2, F.lit(self.dimensions))))
        length = V.norm(grouped)
        return F.transform(grouped, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)).cast("float"))


class HashingArrowEmbedder(HashingEmbedder):
    """The same vectors from an Arrow-batched function: for long texts."""

    def column(self, text):
        n = self.dimensions

        @pandas_udf("array<float>")
        def embed(hashes: pd.Series) -> pd.Series:
            import numpy as np

            def one(h):
                h = np.asarray(h, np.int64)
                v = np.bincount(np.mod(h, n), np.where((h >> 62) % 2 == 0, 1.0, -1.0), n)
                length = np.sqrt(v @ v)
                return (v / length if length else v).astype(np.float32)

            return hashes.map(one)

        return embed(F.transform(T.tokens(text), lambda t: F.xxhash64(t)))


def embed_chunks(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> DataFrame:
    """Chunks with ``embedding``.  With a cache (hash, embedding) cached hashes are not embedded, and of
    the others each hash once; without one every row is."""
    text = T.prepare_text("context", "signature", "docstring", "content")
    if cache is None:
        return chunks.withColumn("embedding", embedder.column(text))
    known, misses = cache_split(chunks, cache)
    fresh = misses.select("hash", embedder.column(text).alias("embedding"))
    return known.unionByName(chunks.join(fresh, "hash"))


def lexical_scorer(query: str):
    """A raw rerank score without a model: query terms that the text has, less a bias."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if t]

    def score(text):
        have = F.array_distinct(T.tokens(text))
        return F.size(F.array_intersect(have, F.array(*map(F.lit, terms)))).cast("double") * 2 - F.lit(float(len(terms)))

    return score


def truncate_utf8(text: str, limit: int) -> str:
    """At most ``limit`` bytes, without cutting a character."""
    return text.encode()[:limit].decode(errors="ignore")


#: Bytes a token that truncation assumes, one attempt after another, when a service refuses a text.
TRUNCATION_STEPS = (3.0, 1.5, 1.0)


class HttpEmbedder:
    """Vectors from an HTTP embedding service, fetched by the tasks, a request for each text.

    A text that the service refuses as too long is sent again, cut harder each time; any other failure
    is an error, so that no text is cut for a lost connection.
    """

    def __init__(self, url: str = "http://localhost:11434", model_name: str = "nomic-embed-text", dimensions: int = 768, context: int = 8192, timeout: float = 30.0):
        self.url, self.model_name, self.dimensions, self.context, self.timeout = url, model_name.split(":")[0], dimensions, context, timeout

    @staticmethod
    def too_long(refusal) -> bool:
        """Whether an HTTP error is about the text's length."""
        said = (refusal.read() or b"").decode(errors="ignore").lower() if refusal.fp else ""
        return refusal.code == 413 or any(x in said for x in ("context length", "too long", "too large", "exceeds"))

    def fetch(self, text: str, opener=None) -> list[float]:
        import json
        import urllib.error
        import urllib.request

        opener = opener or (lambda request: urllib.request.urlopen(request, timeout=self.timeout))
        attempts = [text, *(truncate_utf8(text, int(self.context * step)) for step in TRUNCATION_STEPS)]
        for k, cut in enumerate(attempts):
            body = json.dumps({"model": self.model_name, "prompt": cut}).encode()
            try:
                with opener(urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})) as answer:
                    return json.load(answer)["embedding"]
            except urllib.error.HTTPError as refusal:
                if k + 1 == len(attempts) or not self.too_long(refusal):
                    raise
        raise AssertionError

    def column(self, text):
        fetch = self.fetch

        @pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return texts.map(fetch)

        return embed(text)
