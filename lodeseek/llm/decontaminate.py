"""Benchmark decontamination with suffix arrays of the training text.

The documents are cut into shards of about ``SHARD_BYTES`` bytes (whole documents).  Each shard gets
a suffix array over its words, built by prefix doubling; every suffix of every benchmark item is
located in it by binary search, all occurrences are read off the array and extended to the longest
verbatim match.  Shards are independent, so there is no shuffle: the benchmark goes to the documents
in blocks of at most ``BENCHMARK_BLOCK_BYTES`` of text, which each task searches in turn in one pass.

Defined results: a null or wordless text has no words and is never hit; a null item text has no
windows; a null item id is listed as the empty string; repeated item rows count once; every document
row has a row, without a doc_id or with a repeated one too; an empty benchmark leaves every document clean; a text of any
length is one document, whole; extra columns of either table are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_kernels as K

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Benchmark text that a task holds at once; a larger benchmark has further blocks.
BENCHMARK_BLOCK_BYTES = 8 << 20
#: Words of a shard up to which rank, rank and position fit one 64-bit sort key.
PACKED = 1 << 20

MATCHES = "doc_id long, n_words long, hits array<struct<start: long, length: long>>, items array<string>, longest_words long, longest_item string, longest_start long"


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` ordered by the words from there on, by ``depth`` words at least.

    ids: dense word ranks from 1; 0 ends a document.
    """
    m = len(ids)
    rank, k = ids.astype(np.int64), 1
    order = None
    while True:
        follow = np.zeros(m, np.int64)
        if k < m:
            follow[: m - k] = rank[k:]
        if m <= PACKED:
            key = np.sort((rank.astype(np.uint64) << np.uint64(42)) | (follow.astype(np.uint64) << np.uint64(21)) | np.arange(m, dtype=np.uint64))
            order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
            pair = key >> np.uint64(21)
        else:
            pair = (rank.astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        k *= 2
        new = np.empty(m, bool)
        new[:1] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        dense = np.cumsum(new)
        if k >= depth or dense[-1] == m:
            return order
        rank = np.empty(m, np.int64)
        rank[order] = dense
        # an end of document stays the least rank, whatever follows it
        rank[ids == 0] = 0


def _bound(text: np.ndarray, order: np.ndarray, query: np.ndarray, at: np.ndarray, width: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """For each query suffix, the first place in [low, high) whose suffix is not below (after: is
    above) the query's next ``width`` words; by binary search of all queries together."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        place, sign = order[middle], np.zeros(len(live), np.int8)
        open_, k = np.arange(len(live)), 0
        while len(open_):
            q = live[open_]
            a, b = text[place[open_] + k], query[at[q] + k]
            sign[open_] = np.sign(a - b)
            k += 1
            open_ = open_[(a == b) & (width[q] > k)]
        right = sign <= 0 if after else sign < 0
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]
        live = live[low[live] < high[live]]
    return low


class Benchmark:
    """The items' words and the windows to look for; what is sent to the executors."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, offsets = K.text_bytes(pa.array([t for _, t in items], pa.string()))
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, K.IS_WORD_ALNUM)
        self.names = [n for n, _ in items]
        self.hashes, n = K.word_hashes(data, starts, ends), np.diff(first)
        width = np.minimum(n, window)
        many = np.where(n > 0, n - width + 1, 0)
        self.item = np.repeat(np.arange(len(n)), many)
        base = np.concatenate([[0], np.cumsum(many)])[:-1]
        self.at = np.arange(many.sum()) - np.repeat(base - first[:-1], many)
        self.width = np.repeat(width, many)
        #: words from the suffix's start to its item's end
        self.rest = np.repeat(first[1:], many) - self.at
        self.depth = int(n.max(initial=1))


def matches_of_shard(data: np.ndarray, offsets: np.ndarray, bench: Benchmark):
    """Words of each document, and of each occurrence of a window its document, first word there, the
    longest match from there and the item."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, K.IS_WORD_ALNUM)
    n_docs, n_words = len(offsets) - 1, np.diff(first)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(bench.at):
        return n_words, none, none, none, none
    hashes, ids = np.unique(K.word_hashes(data, starts, ends), return_inverse=True)
    # every document is followed by a 0; one more stands at the end
    text = np.zeros(len(ids) + n_docs + 1, np.int64)
    document = np.repeat(np.arange(n_docs), n_words)
    text[np.arange(len(ids)) + document] = ids + 1
    place = np.searchsorted(hashes, bench.hashes)
    place[place == len(hashes)] = 0
    query = np.append(np.where(hashes[place] == bench.hashes, place + 1, -1), -1)
    # only suffixes whose window has words of this shard alone can occur
    missing = np.concatenate([[0], np.cumsum(query < 0)])
    live = np.flatnonzero(missing[bench.at + bench.width] == missing[bench.at])
    if not len(live):
        return n_words, none, none, none, none
    order = suffix_array(text, bench.depth)
    at, width = bench.at[live], bench.width[live]
    below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(hashes) + 1))])
    low, high = below[query[at]], below[query[at] + 1]
    low = _bound(text, order, query, at, width, low, high, False)
    high = _bound(text, order, query, at, width, low, high, True)
    count = high - low
    which = np.repeat(np.arange(len(live)), count)
    spot = order[np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1] - low, count)]
    length, rest = width[which], bench.rest[live][which]
    open_ = np.flatnonzero(length < rest)
    while len(open_):
        open_ = open_[text[spot[open_] + length[open_]] == query[at[which[open_]] + length[open_]]]
        length[open_] += 1
        open_ = open_[length[open_] < rest[open_]]
    ends_at = np.flatnonzero(text == 0)
    owner = np.searchsorted(ends_at, spot)
    return n_words, owner, spot - owner - first[owner], length, bench.item[live][which]


def _matches(batch_data, batch_offsets, shards, sent: list):
    """Per shard its documents' words and all matches (document, start, length, item's name) in order,
    whatever blocks the benchmark has; of several blocks one at a time is held."""
    words, found = [None] * len(shards), [[] for _ in shards]
    for block in sent:
        bench: Benchmark = block.value
        for k, (i, j) in enumerate(shards):
            words[k], owner, start, length, item = matches_of_shard(batch_data[batch_offsets[i] : batch_offsets[j]], batch_offsets[i : j + 1] - batch_offsets[i], bench)
            found[k] += zip(owner.tolist(), start.tolist(), length.tolist(), [bench.names[q] for q in item.tolist()], strict=True)
        if len(sent) > 1:
            del bench, block._value  # read again for the next batch
    return zip(shards, words, map(sorted, found), strict=True)


def _search(batches, sent: list):
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(1))
        for (i, j), n_words, found in _matches(data, offsets, list(K.blocks(offsets, SHARD_BYTES)), sent):
            rows = [[[], [], 0, None, None] for _ in range(j - i)]
            for d, s, n, name in found:
                row = rows[d]
                if row[0] and s <= (last := row[0][-1])["start"] + last["length"]:
                    last["length"] = max(last["length"], s + n - last["start"])
                else:
                    row[0].append({"start": s, "length": n})
                row[1].append(name)
                if n > row[2]:
                    row[2:] = [n, name, s]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(n_words), pa.array([r[0] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array([sorted(set(r[1])) for r in rows], pa.list_(pa.string()))]
                + [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.int64()), (3, pa.string()), (4, pa.int64()))],
                names=["doc_id", "n_words", "hits", "items", "longest_words", "longest_item", "longest_start"],
            )


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW):
    """The benchmark's distinct (item_id, text) in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").where("text IS NOT NULL").distinct()
    for name, text in rows.toLocalIterator():
        if block and size + len(text.encode()) > BENCHMARK_BLOCK_BYTES:
            yield Benchmark(block, window)
            block, size = [], 0
        block.append((name, text))
        size += len(text.encode())
    yield Benchmark(sorted(block), window)


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row the merged word ranges that occur in the benchmark, the items, and the longest
    verbatim match with its place.  doc_id keeps its type's long form; see MATCHES."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = [spark.sparkContext.broadcast(bench) for bench in benchmark_blocks(benchmark, window)]
    return docs.mapInArrow(lambda batches: _search(batches, sent), MATCHES).withColumn("n_hit", _hit_words("hits"))


def _hit_words(hits: str):
    """Words inside any of the ranges."""
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["start"] + r["length"] - F.greatest(r["start"], acc["to"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["to"], r["start"] + r["length"]).cast("long").alias("to"),
    )
    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step)["n"]


def _clean(batches, sent: list, at: int):
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(at))
        clean = np.ones(batch.num_rows, bool)
        for (i, _), _, found in _matches(data, offsets, list(K.blocks(offsets, SHARD_BYTES)), sent):
            clean[[i + d for d, *_ in found]] = False
        yield batch.filter(pa.array(clean))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without a word inside an occurrence of a benchmark window; columns as given."""
    at = documents.columns.index("text")
    sent = [documents.sparkSession.sparkContext.broadcast(bench) for bench in benchmark_blocks(benchmark, window)]
    return documents.mapInArrow(lambda batches: _clean(batches, sent, at), documents.schema)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_matches``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_words", "longest_item", "longest_start")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract read literally, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in documents:
        own, hit, names = split(text), set(), set()
        for name, item in items:
            w = split(item)
            k = min(window, len(w))
            for s in range(len(w) - k + 1) if k else ():
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == w[s : s + k]:
                        hit |= set(range(p, p + k))
                        names.add(str(name))
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
