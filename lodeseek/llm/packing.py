"""Best-fit packing of tokenised documents by hierarchical merging of residual bins.

Tokenising tasks cut long documents into pieces, pack their own pieces best-fit (longest first) and
emit bins that are nearly full.  The underfull bins go up a tree: each round one task takes those of
``FAN_IN`` tasks as items, packs them best-fit again and emits.  In a best-fit packing no two bins
fit together, so at most one bin of a task is filled half or less, and a larger one can only ever
join such small ones: a task passes its ``partners`` + 1 emptiest bins on and emits the rest.  So
what a task receives is bounded, and after log(tasks) rounds one task is left.  With ``partners=None``
every underfull bin goes up, whatever that takes in the last rounds.

Defined results: a null or empty text is the one token of its end; a text of any length and kind, also
one long run of white space, has the ids of ``tokenizers``; repeated rows of a doc_id are packed each;
an empty table gives no sequences; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Tokens that may be left over in a bin which counts as full.
NEARLY = 4
FAN_IN = 8
#: White space characters in a row from which `tokenizers` itself encodes a text.
LONG_RUN = 10_000
#: Pieces that a tokenising task packs at a time.
LOCAL_PIECES = 250_000
#: Larger bins that a task passes on beside its emptiest one, unless told otherwise.
PARTNERS = 64

MEMBER = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint"
BINS = f"fill int, up boolean, members array<struct<{MEMBER.replace(': ', ':')}>>"
FIELDS = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken, which gives the same ids faster.

    A vocabulary of this kind lists its merges in order of rank, so that ids are ranks.  The file's
    added tokens are known too; ``encode_ordinary`` takes them for plain text, ``encode_text`` does not.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary = file["model"]["vocab"]
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def encode_text(text: str, path: str) -> list[int]:
    """The ids of ``tokenizers`` with add_special_tokens=False: added tokens within the text have their own."""
    if len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
        # here tiktoken's pattern, which looks ahead, would run out of stack
        return slow_encoding(path).encode(text, add_special_tokens=False).ids
    return encoding(path).encode(text, allowed_special="all")


@lru_cache(maxsize=2)
def slow_encoding(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece of a cut one is short."""
    n = len(ids)
    raw = ids.astype("<u4").tobytes()
    first = n if n <= capacity else (n % capacity or capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return [(k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that can take it."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they have left
    some, bins = 0, []  # some: bit r is set if waiting[r] has a bin
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = waiting[left].pop()
            if not waiting[left]:
                some &= ~(1 << left)
            bins[b].append(i)
            left -= size
        else:
            b, left = len(bins), capacity - size
            bins.append([i])
        if left:
            waiting[left].append(b)
            some |= 1 << left
    return bins


def _bins(fills: list[int], members: list[list[tuple]], up: list[bool]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)
    flat = [x for m in members for x in m]
    struct = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for k, (_, t) in enumerate(FIELDS)], names=[n for n, _ in FIELDS])
    return pa.RecordBatch.from_arrays([pa.array(fills, pa.int32()), pa.array(up, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=["fill", "up", "members"])


def _pack_all(items: list[list[tuple]], capacity: int, partners: int | None):
    """Bins of items, each a list of members that stay together; those that go up have ``up`` set."""
    sizes = [sum(m[3] for m in item) for item in items]
    packed = best_fit(sizes, capacity)
    fills = [sum(sizes[i] for i in b) for b in packed]
    underfull = sorted((k for k, n in enumerate(fills) if n < capacity - NEARLY), key=lambda k: fills[k])
    up = set(underfull if partners is None else underfull[: partners + 1])
    for s in range(0, len(packed), 20_000):
        part = range(s, min(s + 20_000, len(packed)))
        yield _bins([fills[k] for k in part], [[m for i in packed[k] for m in items[i]] for k in part], [k in up for k in part])


def _tokenise_and_pack(batches, path: str, capacity: int, partners: int | None):
    items: list[list[tuple]] = []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode_text(text.as_py() or "", path)
            ids.append(END)
            items += [[(doc_id, *p)] for p in pieces_of(np.array(ids, np.uint32), capacity)]
        if len(items) >= LOCAL_PIECES:
            yield from _pack_all(items, capacity, partners)
            items = []
    if items:
        yield from _pack_all(items, capacity, partners)


def _repack(batches, capacity: int, partners: int | None):
    items = [[tuple(m[n] for n, _ in FIELDS) for m in row] for batch in batches for row in batch.column(0).to_pylist()]
    if items:
        yield from _pack_all(items, capacity, partners)


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, fan_in: int = FAN_IN, partners: int | None = PARTNERS) -> DataFrame:
    """One row per sequence: sequence_id, fill, members (pieces in order)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bins = written(docs.mapInArrow(partial(_tokenise_and_pack, path=path or tokenizer_path(), capacity=capacity, partners=partners), BINS), "bins")
    every, open_ = bins.where("NOT up"), bins.where("up")
    tasks = -(-open_.count() // ((PARTNERS if partners is None else partners) + 1))
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        dealt = open_.select("members").repartition(tasks, F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"]))
        bins = written(dealt.mapInArrow(partial(_repack, capacity=capacity, partners=partners), BINS), "bins")
        every, open_ = every.unionByName(bins.where("NOT up")), bins.where("up")
    return every.unionByName(open_).select(F.monotonically_increasing_id().alias("sequence_id"), "fill", "members")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def placed(sequences: DataFrame) -> DataFrame:
    """One row per piece with its place: the members of each sequence, one after another."""
    lengths = F.transform("members", lambda m: m["length"])
    rows = sequences.select("sequence_id", F.posexplode("members").alias("k", "m"), lengths.alias("lengths"))
    offset = F.aggregate(F.slice("lengths", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", offset.alias("offset"))
