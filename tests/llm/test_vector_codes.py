import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lodeseek.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, rest string"


def brute(rows, parts, entries, rounds, scale=4096):
    """Full searches over Python's integers: rows of (id, vector, label) to (id, code, error) and books."""
    ok = [(i, [math.floor(Fraction(x) * scale) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    length = next((len(r[1]) for r in sorted(ok, key=order) if r[1] and len(r[1]) % parts == 0), 0)
    kept = [r for r in ok if len(r[1]) == length]
    w = length // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(r[1])[p] for r in sorted(kept, key=order)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        own = [[near(x, books[p])[1] for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, own) if c[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for i, v, _ in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), (1 << 63) - 1)))
    return sorted(out + [(i, None, None) for i, v, _ in ok if len(v) != length], key=repr), books


def rows_of(n, width, seed=2):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)], rng.choice([0, 1, None])) for i in rng.sample(range(10 * n), n)]
    nan, inf = float("nan"), float("inf")
    odd = [(3, None, 1), (4, rows[0][1][:-1] + [None], 1), (5, [nan] + rows[0][1][1:], 1), (6, [-inf] + rows[0][1][1:], 1), (10**6, rows[0][1] + [1.0], 1), (10**6 + 1, [], 1), (None, rows[2][1], None)]
    return rows + odd + [rows[5], rows[5], (rows[4][0], rows[3][1], 0), (10**7, [0.0] * width, 0)]


@pytest.mark.parametrize("width,parts,entries,rounds", [(64, 8, 16, 6), (6, 3, 4, 2), (4, 2, 200, 1)])
def test_equals_full_search(spark, width, parts, entries, rounds):
    rows = rows_of(90, width)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got, books = V.compress(frame, parts=parts, entries=entries, rounds=rounds)
    expected, theirs = brute(rows, parts, entries, rounds)
    assert books.tolist() == theirs
    assert sorted(((r.id, r.code, r.error) for r in got.collect()), key=repr) == expected
    assert {r.rest.rest for r in got.collect()} == {"y"}


def test_only_the_annulus_is_measured():
    rng = np.random.default_rng(3)
    entries = np.stack([np.full(8, 1000 * k) for k in range(16)]) + rng.integers(-3, 3, (16, 8))
    m = entries[rng.integers(0, 16, 400)] + rng.integers(-4, 4, (400, 8))
    index, distance, measured = V.nearest(m, entries)
    full = ((m[:, None] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()
    assert measured <= 3 * len(m)  # of 16


def test_equal_norms_and_ties():
    """All norms alike: nothing can be pruned; equal distances go to the lower index."""
    entries = np.array([[0, 5], [5, 0], [0, -5], [-5, 0], [5, 0]])
    index, distance, _ = V.nearest(np.array([[1, 0], [0, 0], [4, 4], [-1, -1]]), entries)
    assert index.tolist() == [1, 0, 0, 2] and distance.tolist() == [16, 25, 17, 17]


def test_random_books_equal_full_search():
    rng = np.random.default_rng(5)
    for _ in range(60):
        k, w, top = int(rng.integers(1, 40)), int(rng.integers(1, 9)), int(rng.choice([2, 30, 10**6]))
        entries, m = rng.integers(-top, top, (k, w)), rng.integers(-top, top, (50, w))
        index, distance, _ = V.nearest(m, entries)
        full = ((m[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()


def test_numbers_beyond_a_long(spark):
    rows = [(i, [x * 10.0**k for x in (1, -2, 3 + i, 1)], 0) for i, k in enumerate([0, 3, 9, 20, 30, 36])]
    got, books = V.compress(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), parts=2, entries=3, rounds=2)
    expected, theirs = brute(rows, 2, 3, 2)
    assert books.tolist() == theirs and sorted(((r.id, r.code, r.error) for r in got.collect()), key=repr) == expected


def test_empty(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    only = V.compress(spark.createDataFrame([(1, [1.0], 0, "x", "y"), (2, None, 0, "x", "y")], SCHEMA))[0].collect()
    assert [(r.id, r.code, r.error) for r in only] == [(1, None, None)]


def test_query_and_decoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = V.op12_vector_codes(spark, sf).collect()
    table = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected, books = brute(table, 8, 16, 6)
    assert sorted(((r.vec_id, r.code, r.error) for r in rows), key=repr) == expected
    flat = ",".join(str(x) for book in books for e in book for x in e)
    label, error = {i: g for i, _, g in table}, {i: e for i, _, e in expected}
    for r in rows:
        assert r.codebooks_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert r.label_error == sum(e for i, e in error.items() if label[i] == label[r.vec_id])
    near = V.decode([r.code for r in rows], np.array(books))
    exact = {i: np.floor(4096 * np.array(v, np.float64)) for i, v, _ in table}
    assert all(((near[k] - exact[r.vec_id]) ** 2).sum() == r.error for k, r in enumerate(rows))
