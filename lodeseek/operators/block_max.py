"""Top-k of keywords over postings in blocks, pruned against the score that is enough.

A block is a range of ids; for each field and term it keeps the number of its documents, their highest
frequency and least length, from which no document of the block can score higher.  A search scores the
most promising blocks first; the k-th score found there is a floor, and of all other blocks only those
whose bound reaches it are read.  The result is that of scoring everything.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fts

#: Ids of a block, and blocks of the first wave.
BLOCK, WAVE = 128, 32
#: Bounds and scores add in different orders.
SLACK = 1 + 1e-9


def with_blocks(post: DataFrame) -> DataFrame:
    return post.withColumn("block", F.floor(F.col("id") / BLOCK).cast("long"))


def block_table(post: DataFrame) -> DataFrame:
    """(field, term, block, n, max_tf, min_dl) of postings with ``block`` and ``dl``."""
    return post.groupBy("field", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


#: (documents, blocks at most) of each (field, term); (documents, mean length) of each field.
Frequencies = dict[tuple[str, str], tuple[int, int]]
Totals = dict[str, tuple[int, float]]


def frequencies(blocks: DataFrame, terms: list[str]) -> Frequencies:
    """Of a query's terms: a row a field and term."""
    rows = blocks.where(F.col("term").isin(terms)).groupBy("field", "term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks")).collect()
    return {(r.field, r.term): (r.df, r.blocks) for r in rows}


def _weight(tf: str, dl: str, totals: Totals, df: Frequencies):
    """The score of a field's term, as an expression of constants: a query joins nothing."""
    out = F.lit(0.0)
    for (field, term), (docs, _) in sorted(df.items()):
        n, avgdl = totals[field]
        rarity = math.log(1 + (n - docs + 0.5) / (docs + 0.5))
        own = F.lit(rarity) * fts.term_weight(F.col(tf), F.col(dl), F.lit(float(avgdl)))
        out = F.when((F.col("field") == field) & (F.col("term") == term), own).otherwise(out)
    return out


def _with_all(rows: DataFrame, key: str, weight, name: str, terms: list[str]) -> DataFrame:
    per = rows.where(F.col("term").isin(terms)).groupBy(key).agg(F.sum(weight).alias(name), F.count_distinct("term").alias("have"))
    return per.where(F.col("have") == len(terms)).select(key, name)


def bounds(blocks: DataFrame, totals: Totals, terms: list[str], df: Frequencies) -> DataFrame:
    """(block, bound): what no document of the block exceeds, for blocks that have every term."""
    return _with_all(blocks, "block", _weight("max_tf", "min_dl", totals, df), "bound", terms)


def scores(post: DataFrame, totals: Totals, terms: list[str], df: Frequencies) -> DataFrame:
    """(id, score) of the documents that have every term in some field."""
    return _with_all(post, "id", _weight("tf", "dl", totals, df), "score", terms)


def top_k(post: DataFrame, blocks: DataFrame, totals: Totals, terms: list[str], k: int, df: Frequencies | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, score) of the k best documents with every term, and the blocks read for them.

    df: of the query's terms, if some documents of the blocks are gone.  The driver gets these and one
    number a wave: the k-th score so far.
    """
    terms = sorted(set(terms))
    df = frequencies(blocks, terms) if df is None else df
    promise = bounds(blocks, totals, terms, df)
    slim, wave, floor = post.select("field", "term", "id", "tf", "dl", "block"), WAVE, None
    # a block with every term is counted for each of them
    most = min((sum(b for (_, t), (_, b) in df.items() if t == term) for term in terms), default=0)
    while floor is None and wave < most:
        best = promise.orderBy(F.desc("bound"), "block").limit(wave).select("block")
        found = scores(slim.join(best, "block", "left_semi"), totals, terms, df).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        floor, wave = found.least if found.n == k else None, wave * 8
    if floor is None:
        every, read = scores(slim, totals, terms, df), promise
    else:
        read = promise.where(F.col("bound") * SLACK >= floor)
        every = scores(slim.join(read.select("block"), "block", "left_semi"), totals, terms, df)
    return every.orderBy(F.desc("score"), "id").limit(k), read
