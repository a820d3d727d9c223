import random

import numpy as np
import pytest

from lodeseek.llm import components, ngram_join as N

SCHEMA = "doc_id long, text string, class string, n long"


def family(rng, words, base, copies, edits):
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  \n", "one", "ONE", "one two three", "One Two\tThree", "a b c d e", "a b c d e f"]
    passage = [rng.choice(words) for _ in range(30)]
    for _ in range(6):
        texts += family(rng, words, [rng.choice(words) for _ in range(rng.randint(20, 120))], 6, 3)
    texts += family(rng, words, [rng.choice(words) for _ in range(100)], 60, 5)  # a large bucket
    for _ in range(25):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(own[:3] + passage + own[3:]))
    texts += [texts[12]] * 4
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in N.similar_components(frame).collect()}
    want = set(N.brute_force(rows))
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 20


@pytest.mark.parametrize("blocks,hot", [(2048, False), (7, False), (9, True)])
def test_pairs_across_batches_and_components(spark, monkeypatch, blocks, hot):
    monkeypatch.setattr(N, "SMALL", 1)  # every bucket is a large one
    monkeypatch.setattr(N, "BLOCK_ROWS", blocks)
    if hot:  # every shared shingle is hot
        monkeypatch.setattr(N, "LEAST_SEEN", 1)
        monkeypatch.setattr(N, "COMMON", (0, 0))
    rows = corpus()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in N.similar_components(spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == set(N.brute_force(rows))


def test_rows_without_an_id(spark):
    text = "a b c d e f g h"
    frame = spark.createDataFrame([(None, text, "x", 0), (4, text, "x", 0), (None, "other text", "x", 0), (2, text + " i", "x", 0)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.similar_components(frame).collect()), key=repr)
    assert got == [(2, 5, 2), (4, 4, 2), (None, 1, None), (None, 4, 2)]


def test_empty_table(spark):
    assert N.similar_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trie_matches_equal_counting():
    rng = np.random.default_rng(2)
    for _ in range(40):
        probe = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        sets = []
        for _ in range(12):
            own = probe[rng.random(len(probe)) < rng.choice([0.5, 0.85, 0.95, 1])]
            own = np.unique(np.concatenate([own, rng.integers(0, 400, rng.integers(0, 12)).astype(np.uint64)]))
            if len(own):
                sets.append(own)
        good = N.trie_matches(probe, sets, steps=7)
        for s, g in zip(sets, good, strict=True):
            x = len(np.intersect1d(probe, s))
            assert g == (100 * x >= 80 * (len(probe) + len(s) - x))


@pytest.mark.parametrize("per_task", [5, 10_000])
def test_connected(spark, per_task):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    label = {n: n for link in links for n in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long"), per_task).collect()}
    assert {k: v for k, v in got.items() if k < 300} == {k: v for k, v in label.items() if k < 300}


def test_bitmap(spark):
    rng = random.Random(8)
    for bits in (16, 20):
        cells = {0, (1 << bits) - 1, 32767, 32768, *(rng.randrange(1 << bits) for _ in range(500))}
        got = N._bitmap(spark.createDataFrame([(c,) for c in [*cells, 0]], "cell long"), bits)
        assert len(got) == 1 << bits >> 3
        assert set(np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist()) == cells


def test_one_passage_in_most_documents(spark, monkeypatch):
    """A hot shingle's bucket is held against itself in blocks, none larger than asked for."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{i}x{k}" for k in range(rng.choice([3, 4, 30]))) for i in range(300)]
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    rows = list(enumerate(texts))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in N.similar_components(spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(3)).collect()}
    assert got == set(N.brute_force(rows))
