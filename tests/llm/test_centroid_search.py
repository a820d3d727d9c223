import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lodeseek.llm import centroid_search as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, slot int"


def brute(rows, width, clusters, rounds, scale=1024, seed=3):
    """Full distances over Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((gap(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, k) in zip(kept, own) if k == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, j, min(d, (1 << 63) - 1)) for (i, _), (d, j) in zip(kept, assign())), key=repr), centres


def vectors(n, width, seed=1, spread=2.0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-spread, spread) for _ in range(width)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.4) * (1 + k % 3) for k, m in enumerate(rng.choice(middles))]) for i in range(n)]
    odd = [(n, None), (n + 1, rows[0][1][:-1] + [None]), (n + 2, rows[0][1][:-1] + [float("nan")]), (n + 3, [float("inf")] + rows[0][1][1:]), (n + 4, rows[0][1][1:]), (n + 5, []), (None, rows[3][1])]
    return rows + odd + [rows[7], rows[7], (rows[9][0], rows[8][1]), (rows[9][0], rows[8][1])]


@pytest.mark.parametrize("width,clusters,rounds", [(64, 8, 10), (10, 3, 2), (3, 8, 1)])
def test_equals_full_distances(spark, width, clusters, rounds):
    rows = vectors(120, width)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got, centres = C.cluster(frame, dimensions=width, clusters=clusters, rounds=rounds)
    expected, theirs = brute(rows, width, clusters, rounds)
    assert centres.tolist() == theirs
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_ties_go_to_the_smaller_number_and_few_vectors_seed_all():
    centres = np.array([[0, 4], [4, 0], [0, 4]])
    m = np.array([[2, 2], [0, 0], [0, 4], [5, 0]])
    cluster, distance = C.nearest(m, centres, np.array([1, 0]))
    assert cluster.tolist() == [0, 0, 0, 1] and distance.tolist() == [8, 16, 0, 1]


def test_far_centroids_cost_their_first_block_alone():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (8, 64))
    m = centres[rng.integers(0, 8, 500)] + rng.integers(-5, 5, (500, 64))
    cluster, distance = C.nearest(m, centres, np.arange(64))
    full = ((m[:, None] - centres[None]) ** 2).sum(axis=2)
    assert cluster.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()
    # what stays open behind the first block: each row's own centroid only
    first = ((m[:, None, : C.STEP] - centres[None, :, : C.STEP]) ** 2).sum(axis=2)
    assert (first <= distance[:, None]).sum() == len(m)


def test_numbers_beyond_a_long(spark):
    rows = [(i, [x * 10.0**k for x in (1, -2, 3 + i)]) for i, k in enumerate([0, 3, 9, 20, 30, 36])]
    got, centres = C.cluster(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), dimensions=3, clusters=2, rounds=3)
    expected, theirs = brute(rows, 3, 2, 3)
    assert centres.tolist() == theirs and sorted(map(tuple, got.collect()), key=repr) == expected


def test_empty(spark):
    got, centres = C.cluster(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["id", "cluster", "distance"] and len(centres) == 0
    assert C.cluster(spark.createDataFrame([(1, None, "x", 1)], SCHEMA))[0].collect() == []


def test_query(spark):
    """Sums by cluster and over all, and the hash of each centroid."""
    sf = "/root/testdata/sf0.001"
    rows = C.op11_centroid_search(spark, sf).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected, centres = brute(table, 64, 8, 10)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=repr) == expected
    for r in rows:
        assert r.inertia == sum(d for *_, d in expected) and r.cluster_inertia == sum(d for _, j, d in expected if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
