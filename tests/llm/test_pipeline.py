"""run() against the stages' brute-force versions on a small corpus."""

import random
import zlib

import numpy as np
import pytest

from lodeseek.llm import decontaminate, ngram_join, packing, secret_forest, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def corpus(tmp_path, spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "ka lo mi tu re so be".split() for b in "na pe di vo gu ri".split()]
    docs, labels = [], []
    for i in range(260):
        own = rng.choices(words, k=rng.randint(12, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["zarbo", "flimp"])
        docs.append([i, " ".join(own), "en", f"src{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    items = [(k, " ".join(rng.choices(words, k=14))) for k in range(4)]
    for i in (21, 22, 23):
        docs[i][1] += " x " + items[i % 4][1]
    docs[31][1], docs[32][1] = docs[33][1], docs[33][1] + " tail"
    docs[41][1] += ' token = "0641917ea4e9feb9cda83477b57ac2654884f485" end'
    docs += [[300, None, "en", "src0", 0], [301, "", None, None, None], [302, "word " * 3000, "en", "src1", 0], [None, "no name of its own", "en", "src1", 0]]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, items


def test_run_equals_brute_force(spark, tmp_path):
    docs, items = corpus(tmp_path, spark)
    got = {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert got.pop(None)
    kept = [(i, t) for i, t, *_ in docs if i is not None and model.score(t) < toxicity.THRESHOLD]
    assert all(i % 5 for i, _ in kept if i < 260) and sum(i < 260 for i, _ in kept) == 208
    kept = [(i, t) for (i, t), (_, _, root) in zip(kept, ngram_join.brute_force(kept), strict=True) if root == i]
    kept = [(i, t) for (i, t), hit in zip(kept, decontaminate.brute_force(kept, items), strict=True) if not hit[5]]
    assert {21, 22, 23, 32, 33} & {i for i, _ in kept} == set() and 31 in {i for i, _ in kept}
    want, encode = {}, lambda t: packing.encode_text(t, packing.tokenizer_path())
    for i, t in kept:
        t = (t or "").replace("0641917ea4e9feb9cda83477b57ac2654884f485", secret_forest.REPLACEMENT)
        ids = np.array([*encode(t), 0], "<u4")
        want[i] = packing.pieces_of(ids, packing.CAPACITY)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in want[i])
    assert {i: sorted(v) for i, v in got.items()} == want


def test_stages_keep_columns_and_stand_empty_tables(spark, tmp_path):
    corpus(tmp_path, spark)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_unlike_texts_of_one_doc_id_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(5, a), (5, a), (5, b), (9, a + " more"), (12, b + " more"), (5, None), (7, ""), (7, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", "mine") for i, t in rows], "doc_id long, text string, lang string, source string, key string")
    got = pipeline.STAGES[1][1](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("5", a), ("5", b), ("5", "None"), ("7", ""), ("None", a)])


def test_a_stage_begins_with_a_collected_heap(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    import corpus_pipeline

    corpus_pipeline.pack_sequences(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert full() > before
