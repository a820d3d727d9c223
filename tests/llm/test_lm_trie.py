import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeseek.llm import lm_trie as L
from lodeseek.llm.elias_fano import EliasFano

SCHEMA = "doc_id long, text string, word string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Model:
    """The formulas read literally."""

    def __init__(self, train, b, m):
        self.b, self.m = b, m
        rows = [["<s>", "<s>", *t] for t in train]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v, self.docs = sum(self.c.values()), len(self.c), len(train)
        self.pairs = Counter(p for r in rows for p in zip(r[1:], r[2:]))
        self.triples = Counter(p for r in rows for p in zip(r, r[1:], r[2:]))

    def p1(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def p(self, w, h1, h2):
        before = self.docs if h1 == "<s>" else self.c[h1]
        both = self.docs if h1 == "<s>" else self.pairs[h2, h1]
        return (self.triples[h2, h1, w] + self.b * self.pairs[h1, w] + self.m * self.p1(w)) / (both + self.b * before + self.m)

    def score(self, own):
        r = ["<s>", "<s>", *own]
        return sum(math.log10(self.p(w, h1, h2)) for h2, h1, w in zip(r, r[1:], r[2:]))


@pytest.mark.parametrize("hot,per_shard", [(50_000, 2_000_000), (20, 300)])
def test_scores_equal_the_formula(spark, monkeypatch, hot, per_shard):
    masses = {}
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(L, "PER_SHARD", per_shard)
    made = L.Corpus.__init__

    def keep(self, *a):
        made(self, *a)
        masses["m"] = (self.b, self.m)

    monkeypatch.setattr(L.Corpus, "__init__", keep)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 60))), "x") for i in range(80)]
    rows += [(i, "w1 w2 w3 " * rng.randint(1, 9) + "w9 w8 w7", "x") for i in range(200, 230)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "Unseen WORDS", "x"), (3, "again other text", "x"), (None, "w1 w2", "x")]
    got = sorted(L.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.base_score))
    model = Model([tokens(t) for i, t, _ in rows if not is_held(i)], *masses["m"])
    want = [(i, is_held(i), len(own), sum(model.c[w] > 0 for w in own), model.n, sum(math.log10(model.p1(w)) for w in own), model.score(own)) for i, own in ((i, tokens(t)) for i, t, _ in rows)]
    want.sort(key=lambda r: (r[0] is None, r[0], r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], abs=1e-6)
        assert g.score == pytest.approx(w[6], abs=1e-3 * w[2])


def test_probabilities_sum_to_one():
    rng = random.Random(3)
    model = Model([[*rng.choices("abcd", k=rng.randint(0, 9)), None] for _ in range(30)], 1 / 8, 16.0)
    for h2, h1 in [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("x", "a"), ("d", "d"), ("a", "x")]:
        assert sum(model.p(w, h1, h2) for w in [*model.c, "unknown"]) == pytest.approx(1)


def leave_one_out(rows, b, m):
    """The likelihood of the training tokens by the formula, each token taken out of all counts."""
    model = Model([tokens(t) for i, t, _ in rows if not is_held(i)], b, m)
    total = 0.0
    for own in (tokens(t) for i, t, _ in rows if not is_held(i)):
        r = ["<s>", "<s>", *own]
        for h2, h1, w in zip(r, r[1:], r[2:]):
            before, both = (model.docs, model.docs) if h1 == "<s>" else (model.c[h1], model.pairs[h2, h1])
            p1 = model.c[w] / (model.n + model.v)
            total += math.log((model.triples[h2, h1, w] - 1 + b * (model.pairs[h1, w] - 1) + m * p1) / (both - 1 + b * (before - 1) + m))
    return total


def chosen(spark, monkeypatch, rows, share):
    found = []
    real = L.weights
    with monkeypatch.context() as patch:
        patch.setattr(L, "PAIR_SHARE", share)
        patch.setattr(L, "weights", lambda *a: found.append(real(*a)) or found[-1])
        L.score(spark.createDataFrame(rows, SCHEMA)).count()
    return found[0]


def test_weights_have_the_highest_likelihood(spark, monkeypatch):
    """Words that depend on what is before them get a small weight of the lowest level, others a large one."""
    rng = random.Random(6)
    chain, free = [], []
    for i in range(30):
        k, own = 0, []
        for _ in range(200):
            k = (k * 5 + rng.randint(0, 1)) % 101
            own.append(f"w{k}")
        chain.append((i, " ".join(own), ""))
        free.append((i, " ".join(f"w{rng.randint(0, 100)}" for _ in range(200)), ""))
    best = []
    for rows in (chain, free):
        grid = {(b, m): leave_one_out(rows, b, m) for b in L.SHARES for m in L.MASSES}
        best.append(chosen(spark, monkeypatch, rows, 1))
        assert best[-1] == max(grid, key=grid.get)
        # a part of the pairs tells as much, within what the weights differ by
        part = chosen(spark, monkeypatch, rows, 4)
        assert grid[part] >= grid[best[-1]] - 0.02 * abs(grid[best[-1]])
    assert best[0][1] < best[1][1]


def test_scores_do_not_depend_on_batches_or_partitions(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 120))), "") for i in range(120)]
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size, parts in (("2", 1), ("20", 8), ("10000", 1)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            seen.append({r.doc_id: r.score for r in L.score(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for other in seen[1:]:
        assert other == pytest.approx(seen[0], abs=1e-6)


def test_a_very_long_text(spark):
    """One text of a million words is one row with the score of its words."""
    rows = [(0, "a b c " * 350_000, ""), (1, "a b c", "")]
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_tokens == 1_050_001 and got[0].n_known == 1_050_001 and got[0].score > got[0].base_score


def test_level_lookups():
    rng = np.random.default_rng(4)
    for nodes, n in ((1, 1), (7, 60), (300, 5000)):
        pairs = np.unique(rng.integers(0, nodes, n) * 1000 + rng.integers(0, 1000, n))
        node, ids = pairs // 1000, pairs % 1000
        level = L.Level(node, ids, -ids / 100, nodes, 1000)
        asked_node, asked = rng.integers(-1, nodes, 4000), rng.integers(0, 1000, 4000)
        place = level.find(asked_node, asked)
        key = asked_node * 1000 + asked
        assert ((place >= 0) == (np.isin(key, pairs) & (asked_node >= 0))).all()
        assert (pairs[place[place >= 0]] == key[place >= 0]).all()
        assert np.abs(level.value(place)[place >= 0] + asked[place >= 0] / 100).max(initial=0) <= L.QUANTUM


def test_no_training_rows_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = L.score(spark.createDataFrame([(held, "a b", "x")], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert L.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1 << 64), (1, 1 << 64), (5000, 1 << 64), (3000, 1 << 50), (200, 256)):
        values = np.unique(rng.integers(0, min(top, 1 << 63) - 1, n, dtype=np.uint64))
        sequence = EliasFano(values, top)
        asked = np.concatenate([values, rng.integers(0, min(top, 1 << 63) - 1, 300, dtype=np.uint64)])
        assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
        assert (sequence.at(np.arange(len(values))) == values).all()
        assert ((sequence.find(asked) >= 0) == np.isin(asked, values)).all()


def test_weights_come_from_every_pair(spark, monkeypatch):
    """In small corpora, where a part of the pairs would choose other weights."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 50}" for _ in range(rng.randint(1, 12))), "") for i in range(24)]
        grid = {(b, m): leave_one_out(rows, b, m) for b in L.SHARES for m in L.MASSES}
        assert chosen(spark, monkeypatch, rows, L.PAIR_SHARE) == max(grid, key=grid.get)


def test_what_shards_are_dealt_and_answer_grows_with_the_tokens_alone():
    """Each n-gram of a chunk once, so that bytes hardly depend on the number of shards."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(400)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    moved = []
    for shards in (2, 60):
        rows = [r for b in L._dealt([batch], shards) for r in b.to_pylist()]
        answers = [r for s in range(shards) if (own := [r for r in rows if r["shard"] == s]) for b in L._answered([pa.RecordBatch.from_pylist(own, pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in L.BLOBS.split(", "))]))], shards) for r in b.to_pylist()]
        assert sum(r["docs"] for r in answers) == sum(not is_held(i) for i in range(300))
        moved.append(sum(len(x) for r in rows + answers for x in r.values() if isinstance(x, bytes)) / (300 * 401))
    assert moved[1] < 1.25 * moved[0] and max(moved) < 16


def test_elias_fano_bytes_and_few_keys():
    from lodeseek.llm import elias_fano

    rng = np.random.default_rng(7)
    for n, top in ((0, 1 << 64), (1, 1 << 64), (5000, 1 << 56), (3000, 3001)):
        values = np.unique(rng.integers(0, min(top, 1 << 63) - 1, n, dtype=np.uint64))
        assert (elias_fano.decoded(elias_fano.encoded(values, top)) == values).all()
        sequence, asked = EliasFano(values, top), np.concatenate([values[:20], rng.integers(0, min(top, 1 << 63) - 1, 20, dtype=np.uint64)])
        assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
        assert ((sequence.find(asked) >= 0) == np.isin(asked, values)).all()


def test_other_documents_at_the_second_reading_are_an_error():
    import pyarrow as pa

    batch = lambda text: pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    (chunk,), (other,) = L._read_again([batch("a b c")]), L._read_again([batch("a b d")])
    assert chunk["batch"] == other["batch"] and chunk["digest"] != other["digest"]
    with pytest.raises(ValueError, match="not the same"):
        L._scored(pa.Table.from_batches([chunk]), pa.table({"batch": pa.array([], pa.int64())}), L.Corpus(0, 0, 0, 0.0, 0.0), 1)
