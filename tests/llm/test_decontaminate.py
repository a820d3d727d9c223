import random

from lodeseek.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, note string"


def run(spark, docs, items):
    found = D.find_matches(spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    return {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.longest_words) for r in found.collect()}


def fixture(rng, words):
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 11, 14, 30])))) for i in range(12)] + [(90, None), (3, "again again"), (3, "again again")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "Again, AGAIN and again")]
    for i in range(4, 60):
        own = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            s = rng.randrange(len(w) + 1)
            own[rng.randrange(len(own) + 1) : 0] = w[s:]
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(own).upper()))
    return docs, items


def test_hits_equal_brute_force(spark):
    for seed, words in ((1, ["aa", "b", "cé"]), (2, [f"w{i}" for i in range(50)])):
        docs, items = fixture(random.Random(seed), words)
        got = run(spark, docs, items)
        for doc_id, n, hit, k, _, _ in D.brute_force(docs, items):
            assert got[doc_id][:2] == (n, hit), doc_id
            assert len(got[doc_id][2]) == k


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    docs, items = fixture(random.Random(3), ["aa", "b", "cc"])
    whole = run(spark, docs, items)
    monkeypatch.setattr(D, "BENCHMARK_BLOCK_BYTES", 40)
    assert run(spark, docs, items) == whole


def test_shard_too_long_for_packed_keys(spark, monkeypatch):
    docs, items = fixture(random.Random(4), ["aa", "b", "cc"])
    import numpy as np

    ids = np.random.default_rng(0).integers(0, 4, 300)
    packed = D.suffix_array(ids, 1 << 20)
    monkeypatch.setattr(D, "PACKED", 10)
    wide = D.suffix_array(ids, 1 << 20)
    assert packed.tolist() == wide.tolist()


def test_empty_tables_and_filter(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b")], [])[1][:3] == (2, 0, [])
    docs = spark.createDataFrame([(1, "x y", 0), (2, "the x y z", 0), (2, "the x y z", 0), (3, "x", 0)], DOCS)
    kept = D.decontaminate(docs, spark.createDataFrame([(7, "X-Y", "n")], ITEMS))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]


def test_blocks_keep_every_row(spark, monkeypatch):
    docs, items = fixture(random.Random(5), ["aa", "b", "cc"])
    docs = [(None if i % 3 == 0 else i // 4, t) for i, t in docs]
    columns = ["doc_id", "n_words", "n_hit", "hits", "items", "longest_words", "longest_item", "longest_start"]

    def rows():
        found = D.find_matches(spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
        return sorted(map(repr, map(tuple, found.select(columns).collect())))

    whole = rows()
    assert len(whole) == len(docs)
    monkeypatch.setattr(D, "BENCHMARK_BLOCK_BYTES", 40)
    assert rows() == whole
    want = sorted((str(i), n, hit, k) for i, n, hit, k, _, _ in D.brute_force(docs, items))
    got = D.find_matches(spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"])) for r in got) == want


def test_digests_and_rows_over_many_blocks(spark, monkeypatch):
    """Repeated and missing ids are rows of their own, whatever blocks the benchmark has."""
    docs, items = fixture(random.Random(5), ["aa", "b", "cc"])
    docs += [docs[9], (None, docs[9][1]), (None, "aa b cc"), (docs[9][0], "other"), (None, None)]
    want = sorted(D.brute_force(docs, items), key=repr)
    for size in (8 << 20, 3):
        monkeypatch.setattr(D, "BENCHMARK_BLOCK_BYTES", size)
        d, b = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
        got = D.report(D.find_matches(d, b)).collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == want
        kept = [(r.doc_id, r.text) for r in D.decontaminate(d, b).collect()]
        assert sorted(kept, key=repr) == sorted(((i, t) for (i, t), w in zip(docs, D.brute_force(docs, items), strict=True) if not w[5]), key=repr)
