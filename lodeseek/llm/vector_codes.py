"""Compression of vectors to codes of a product quantiser, searched by annular norm pruning.

Vectors are cut into parts; every part position has a codebook.  A search sorts a codebook's entries by
norm and starts at the entry whose norm is nearest to the part's.  By the triangle inequality an entry
nearer than the best distance d so far has a norm within sqrt(d) of the part's norm: binary search gives
that interval of the sorted norms, ends included, and only entries in it are measured, outward from the
start, while the interval shrinks with every better entry.  Norms are rounded, so the interval is
widened by more than that; distances are exact integers, so codes are those of a full search, ties included.

A round is one pass over the table in Arrow batches; tasks hand on sums by entry, and the driver holds
the codebooks only.

Defined results: rows without a vector or with null or non-finite components are left out; repeated rows
count each and seed in order of their vectors; rows with a null id seed after all others; with fewer rows
than entries the codebooks are smaller; vectors of another length than the least id's that can be cut
into equal parts have no code (null, also as error) and no part in the codebooks; an empty table gives an
empty result; errors beyond a 64-bit integer come as the largest one; further columns stay out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import integer_vectors as I
from .storage import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def norms(m: np.ndarray) -> np.ndarray:
    """The rows' lengths, off by less than one."""
    squares = (m * m).sum(axis=1)
    return np.sqrt(squares.astype(np.float64)) if m.dtype != object else np.array([math.isqrt(int(s)) for s in squares], object)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) if d.dtype != object else np.array([math.isqrt(int(x)) for x in d], object)


def nearest(m: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, distance) of each row's nearest entry, the lower index among equals, and how many
    distances were measured."""
    m, e = I.alike(m, entries)
    length, own = norms(m), norms(e)
    by_norm = np.array(sorted(range(len(e)), key=lambda k: (own[k], k)), np.int64)
    ring, sorted_e = own[by_norm], e[by_norm]

    def distance(rows, at):
        gap = m[rows] - sorted_e[at]
        return (gap * gap).sum(axis=1)

    every = np.arange(len(m))
    start = np.searchsorted(ring, length).clip(0, len(e) - 1)
    best, index, measured = distance(every, start), by_norm[start], len(m)
    for step in range(1, len(e)):
        for at in (start + step, start - step):
            reach = roots(best) + 3
            low, high = np.searchsorted(ring, length - reach, "left"), np.searchsorted(ring, length + reach, "right")
            rows = every[(at >= low) & (at < high)]
            d, found = distance(rows, at[rows]), by_norm[at[rows]]
            won = ((d < best[rows]) | ((d == best[rows]) & (found < index[rows]))).astype(bool)
            best[rows[won]], index[rows[won]] = d[won], found[won]
            measured += len(rows)
    return index, best, measured


def encode(m: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of every part; ``books``: part, entry, component."""
    width = books.shape[2]
    found = [nearest(m[:, p * width : (p + 1) * width], book)[:2] for p, book in enumerate(books)]
    return np.stack([x for x, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def fit(kept: DataFrame, books: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning and moving; kept: a vector column alone."""
    parts, entries, width = books.shape
    for _ in range(rounds):

        def sums(batches, books=books):
            totals = np.zeros((parts, entries, width + 1), object)
            for b in batches:
                m = I.matrix(b.column(0), parts * width, scale)
                codes, _ = encode(m, books)
                for p in range(parts):
                    own = m[:, p * width : (p + 1) * width]
                    for k in np.unique(codes[:, p]):
                        chosen = own[codes[:, p] == k]
                        totals[p, k, :width] += chosen.sum(axis=0).astype(object)
                        totals[p, k, width] += len(chosen)
            yield I.partial_rows(totals)

        totals = I.summed(kept.mapInArrow(sums, I.PARTIALS), (parts * entries, width + 1))
        new = I.moved(books.reshape(parts * entries, width), totals).reshape(books.shape)
        if np.array_equal(new, books):
            break  # further rounds would repeat this one
        books = new
    return books


def compress(embeddings: DataFrame, id_col: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, further columns, code, error) of every usable vector, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    others = [c for c in embeddings.columns if c not in (id_col, column)]
    plain = embeddings.select(F.col(id_col).alias("id"), F.col(column).alias("v"), *(F.struct(*others),) if others else (F.lit(None),)).toDF("id", "v", "rest")
    plain = I.usable(plain, "v")
    fits = f"size(v) > 0 AND size(v) % {parts} = 0"
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = plain.where(fits).orderBy(*order).select(F.size("v").alias("n")).first()
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = f"id {kinds['id']}, rest {kinds['rest']}, code string, error long"
    if first is None:
        return plain.select("id", "rest", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    length = first.n
    kept = plain.where(F.size("v") == length)
    seeds = I.scaled(np.array([r.v for r in kept.orderBy(*order).select("v").limit(entries).collect()]), scale)
    books = fit(kept.select("v"), seeds.reshape(len(seeds), parts, length // parts).transpose(1, 0, 2).copy(), rounds, scale)

    def assign(batches):
        for b in batches:
            codes, errors = encode(I.matrix(b.column(1), length, scale), books)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            error = [min(sum(map(int, e)), I.MOST) for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["id", "rest", "code", "error"])

    rows = kept.mapInArrow(assign, schema)
    unlike = plain.where(F.size("v") != length).select("id", "rest", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return rows.unionByName(unlike), books


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The scaled vectors for which codes stand."""
    return np.array([np.concatenate([books[p, k] for p, k in enumerate(bytes.fromhex(c))]) for c in codes])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    rows = written(rows.select(F.col("id").alias("vec_id"), F.col("rest.label").alias("label"), "code", "error"), "codes")
    most = F.lit(I.MOST).cast("decimal(38,0)")
    labels = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    sha = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    # null labels meet too; Spark broadcasts the sums only below its size threshold, else splits skew
    out = rows.join(labels, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


_PART = 64 // PARTS
_GAP = f"list_sum(list_transform(range(1, {_PART + 1}), lambda i: (k.v[i] - e.v[i]) * (k.v[i] - e.v[i])))::BIGINT"


def _round_sql(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (SELECT rid, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, p, c, {_GAP} AS d FROM k JOIN c{k} e USING (p)) GROUP BY rid, p),
s{k} AS MATERIALIZED (SELECT p, c, list(x ORDER BY i) AS v FROM (SELECT p, c, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{k} JOIN k USING (rid, p), (SELECT unnest(range(1, {_PART + 1})) AS i) GROUP BY p, c, i) GROUP BY p, c),
c{k + 1} AS MATERIALIZED (SELECT p, c, coalesce(s.v, o.v) AS v FROM c{k} o LEFT JOIN s{k} s USING (p, c))"""


#: For vectors of 64 components, as the table has them.
SQL = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
k AS MATERIALIZED (SELECT rid, p, w[p * {_PART} + 1:(p + 1) * {_PART}] AS v FROM w, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, c, v FROM k JOIN (SELECT rid, (row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1)::INT AS c FROM w) USING (rid) WHERE c < {ENTRIES}),
{",".join(_round_sql(k) for k in range(ROUNDS))},
f AS (SELECT rid, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM (SELECT rid, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, p, c, {_GAP} AS d FROM k JOIN c{ROUNDS} e USING (p)) GROUP BY rid, p) GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN w USING (rid), h
"""
