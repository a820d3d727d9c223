"""Segments, versions, cells, blocks and caches."""

import json
import os
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import ann, block_max, embedding, fts, vector_search
from lodeseek.operators.embedding_cache import EmbeddingCache
from lodeseek.plans.index import Index, search
from lodeseek.plans.log import Log
from lodeseek.streaming import watch as W

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(1)
    words = "alpha beta gamma delta omega row table save load parse".split()
    for k in range(12):
        at = tmp_path / "tree" / f"d{k % 3}" / f"f{k}.md"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("\n".join(" ".join(rng.choices(words, k=8)) for _ in range(130)))
    return tmp_path / "tree"


def index_at(spark, path, **more):
    return Index(spark, str(path), embedding.HashingArrowEmbedder(16), **more)


def hits(index, query, mode="and"):
    """What a keyword search finds, by content, with scores."""
    chunks = index.read("chunks").select(F.col("chunk_id").alias("id"), "path", "start_line")
    return sorted((r.path, r.start_line, round(r.score, 9)) for r in index.keyword_hits(query, 200, mode).join(chunks, "id").collect())


def folder_bytes(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_a_change_writes_what_changed_and_equals_a_rebuild(spark, tree, tmp_path):
    index = index_at(spark, tmp_path / "db")
    index.index(str(tree))
    base = index.entry()["segments"][0]["name"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "db").rglob(f"*segment={base}/*.parquet")}
    (tree / "d0/f0.md").write_text("alpha alpha fresh words\n")
    (tree / "d1/f1.md").unlink()
    (tree / "d2/new.md").write_text("alpha beta unheard\n")
    index.index(str(tree))
    made = index.entry()["made"]
    assert {p: p.stat().st_mtime_ns for p in before} == before
    new = sum(folder_bytes(tmp_path / "db" / t / f"segment={made}") for t in Index.SCHEMAS)
    assert new < 0.6 * sum(folder_bytes(tmp_path / "db" / t / f"segment={base}") for t in Index.SCHEMAS)
    assert folder_bytes(tmp_path / "db/postings" / f"segment={made}") < 0.2 * folder_bytes(tmp_path / "db/postings" / f"segment={base}")

    rebuilt = index_at(spark, tmp_path / "full")
    rebuilt.index(str(tree))
    assert index.entry()["totals"] == rebuilt.entry()["totals"]
    for query, mode in (("alpha", "and"), ("alpha beta", "and"), ('"alpha beta"', "and"), ("alpha unheard", "or"), ("fresh", "and")):
        assert hits(index, query, mode) == hits(rebuilt, query, mode) != []
    plain = lambda i: sorted((r.path, r.hash, r.chunk_count) for r in i.read("files").collect())
    assert plain(index) == plain(rebuilt) and index.stats() == rebuilt.stats()
    near = lambda i: sorted(round(r.cosine, 6) for r in i.vector_hits("alpha unheard", 5, probes=10**6).collect())
    assert near(index) == near(rebuilt)

    # one segment again, with what is live alone
    old = index.read("chunks")
    rows = sorted(map(str, old.collect()))
    assert index.compact(full=True) == index.version
    assert len(index.entry()["segments"]) == 1 and not index.entry()["tombstones"]
    assert sorted(map(str, index.read("chunks").collect())) == rows and hits(index, "alpha beta") == hits(rebuilt, "alpha beta")
    assert sorted(map(str, old.collect())) == rows  # a reader of the version before
    assert index.vacuum(older_than=3600) == 0 and index.vacuum(older_than=-1) > 0
    assert sorted(map(str, index.read("chunks").collect())) == rows and index.log.versions() == [index.version]


def test_segments_are_merged_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Index, "FAN", 3)
    at = tmp_path / "tree"
    at.mkdir()
    index = index_at(spark, tmp_path / "db")
    for k in range(Index.FAN + 1):
        (at / f"f{k}.md").write_text(f"word{k} common\n")
        (at / "f0.md").write_text(f"word0 common again{k}\n")
        index.index(str(at))
        assert len(index.entry()["segments"]) < Index.FAN
    assert len(hits(index, "common")) == Index.FAN + 1 and index.entry()["totals"]["content"][0] == Index.FAN + 1
    assert hits(index, f"again{Index.FAN}") and not hits(index, "again1")


def test_two_writers(spark, tree, tmp_path, monkeypatch):
    """The slower writer starts again from what the faster one left; no file of either is lost."""
    one, two = index_at(spark, tmp_path / "db"), index_at(spark, tmp_path / "db")
    one.index(str(tree))
    reader, before = one.read("chunks"), one.read("chunks").count()
    (tree / "mine.md").write_text("mine alone\n")
    (tree / "theirs.md").write_text("theirs alone\n")
    put, lost = Log.put, []

    def slow(self, n, entry):
        if self is one.log and not lost:
            two.apply(spark.createDataFrame([(f"{tree}/theirs.md", "new"), (f"{tree}/d0/f0.md", "deleted")], "path string, status string"), W.S.readable(W.S.walk(spark, str(tree))))
            assert not put(self, n, entry)  # the number is taken
            lost.append(entry["made"])
            return False
        return put(self, n, entry)

    monkeypatch.setattr(Log, "put", slow)
    one.apply(spark.createDataFrame([(f"{tree}/mine.md", "new")], "path string, status string"), W.S.readable(W.S.walk(spark, str(tree))))
    assert lost and not (tmp_path / "db/chunks" / f"segment={lost[0]}").exists()
    assert hits(one, "mine") and hits(one, "theirs")
    ids = [r.chunk_id for r in one.read("chunks").select("chunk_id").collect()]
    assert len(ids) == len(set(ids)) and f"{tree}/d0/f0.md" not in {r.path for r in one.read("files").collect()}
    assert reader.count() == before and one.read("chunks", 1).count() == before


def test_log(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.latest() is None and log.versions() == []
    assert log.put(1, {"a": 1}) and not log.put(1, {"a": 2}) and log.put(2, {"a": 3})
    assert log.read(1) == {"a": 1} and log.latest() == (2, {"a": 3})
    log.forget(2)
    assert log.versions() == [2] and sorted(os.listdir(tmp_path / "log")) == ["00000000000000000002.json"]


def test_only_recorded_changes_are_applied(spark, tree, tmp_path):
    """Files that changed without a record are found by the next whole run."""
    index = index_at(spark, tmp_path / "db")
    index.index(str(tree))
    (tree / "a.md").write_text("first a\n")
    (tree / "b.md").write_text("first b\n")
    index.index(str(tree))
    (tree / "a.md").write_text("second a\n")
    (tree / "b.md").write_text("second b\n")
    (tree / "c.md").write_text("second c\n")
    records = spark.createDataFrame([(1, "modified", f"{tree}/a.md", None)], W.CHANGES)
    W.apply_changes(index, str(tree), records)
    found = lambda: sorted(Path(p).name for p, *_ in hits(index, "second"))
    assert found() == ["a.md"] and [Path(p).name for p, *_ in hits(index, "first")] == ["b.md"]
    index.index(str(tree))
    assert found() == ["a.md", "b.md", "c.md"] and hits(index, "first") == []


def test_recorded_files_alone_are_read(spark, tree, tmp_path):
    index = index_at(spark, tmp_path / "db")
    paths = spark.createDataFrame([(f"{tree}/d0/f0.md",), (f"{tree}/nothing.md",), (f"{tree}/d0",)], "path string")
    files = W.recorded(index, str(tree), paths)
    assert [Path(r.path).name for r in files.collect()] == ["f0.md"]
    assert [Path(f).name for f in files.inputFiles() if f.endswith(".md")] == ["f0.md"]


# ---- cells


def recall_of(v, marks, path):
    ann.write(ann.with_cells(v, marks), path)
    stored, probes = v.sparkSession.read.parquet(path), ann.tuned_probes(v, marks)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = {(r.query_id, r.id) for r in ann.batch_search(stored, marks, q, 10, probes).collect()}
    exact = {(r.query_id, r.id) for r in vector_search.batch_top_k(v, q, 10).collect()}
    return stored, probes, found, len(found & exact) / len(exact)


def test_recall_of_vectors_in_all_directions(spark, tmp_path):
    """Neighbours lie in most cells; the probes are tuned until the recall holds."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    marks = ann.landmarks(v)
    *_, recall = recall_of(v, marks, str(tmp_path / "cells"))
    assert recall >= 0.9


def test_recall_and_files_read_of_vectors_in_groups(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (30, 32))
    m = middles[rng.integers(0, 30, 3000)] + rng.normal(0, 0.4, (3000, 32))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    marks = ann.landmarks(v)
    stored, probes, found, recall = recall_of(v, marks, str(tmp_path / "cells"))
    assert recall >= 0.9 and len(marks) > 50 and probes <= len(marks) / 4
    query = [float(x) for x in np.float32(m[0])]
    rows = ann.search(stored, marks, query, 10, probes)
    assert {r.id for r in rows.collect()} == {i for q, i in found if q == 0}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() < len(stored.inputFiles()) / 3


def test_cells_of_odd_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 2.0])], "id long, embedding array<float>")
    marks = ann.landmarks(v, cells=10)
    assert len(marks) == 3 and ann.landmarks(v.limit(0)) == []
    got = {r.id: r.cell for r in ann.with_cells(v, marks).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1] == got[2] == marks.index([1.0, 0.0]) and got[5] == marks.index([0.0, 2.0])
    assert ann.cell_count(0) == 1 and ann.cell_count(10**12) == ann.MOST_CELLS
    assert ann.tuned_probes(v, marks) <= 3 and ann.tuned_probes(v.limit(0), []) == 1


def test_a_search_reads_more_cells_where_they_are_short_of_rows(spark, tree, tmp_path):
    index = index_at(spark, tmp_path / "db")
    index.index(str(tree))
    entry, vector = index.entry(), index.embed_query("alpha")
    assert len(index.probed(entry, vector, 1, probes=1)) == 1
    assert sum(sum(s["cells"].get(str(c), 0) for s in entry["segments"]) for c in index.probed(entry, vector, 20, probes=1)) >= 20
    assert index.vector_hits("alpha", 20, probes=1).count() == 20
    (tree / "d0/f0.md").unlink()
    index.index(str(tree))
    assert not [r for r in index.vector_hits("alpha", 200).join(index.read("chunks").withColumnRenamed("chunk_id", "id"), "id").collect() if r.path.endswith("f0.md")]


# ---- blocks


def full_top(docs, terms, k):
    """Full scoring by the plain way."""
    found = fts.search(docs, "id", {"a": "a", "b": "b"}, " ".join(terms))
    return [(r.id, round(r.score, 9)) for r in found.orderBy(F.desc("score"), "id").limit(k).collect()]


@pytest.mark.parametrize("k,wave", [(5, 1), (40, 2), (5000, 32)])
def test_pruned_top_equals_full_scoring(spark, monkeypatch, k, wave):
    monkeypatch.setattr(block_max, "WAVE", wave)
    rng = random.Random(k)
    rows = [(i, " ".join(rng.choices(["x", "y", "z", "w"], [1, 2, 9, 30], k=rng.randint(0, 30))), rng.choice(["x", "", None])) for i in range(3000)]
    rows += [(10_000 + i, "x y " * 8, "x y") for i in range(100)]  # the best ones lie together
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    fields = {"a": "a", "b": "b"}
    post = block_max.with_blocks(fts.all_postings(docs, "id", fields)).cache()
    blocks = block_max.block_table(post)
    totals = {r.field: (r.n, r.avgdl) for r in fts.corpus_stats(fts.lengths(docs, "id", fields)).collect()}
    top, read = block_max.top_k(post, blocks, totals, ["x", "y"], k)
    assert [(r.id, round(r.score, 9)) for r in top.collect()] == full_top(docs, ["x", "y"], k)
    if k == 5:
        assert read.count() < 0.3 * blocks.select("block").distinct().count()
    if k == 5000:
        assert read.count() == block_max.bounds(blocks, totals, ["x", "y"], block_max.frequencies(blocks, ["x", "y"])).count()
    assert block_max.top_k(post, blocks, totals, ["x", "unheard"], k)[0].collect() == []


# ---- caches


def test_cached_texts_are_embedded_once_and_the_cache_is_not_shuffled(spark, tree, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"), buckets=4)
    seen = spark.sparkContext.accumulator(0)

    class Counting(embedding.HashingEmbedder):
        def column(self, text):
            from pyspark.sql.functions import pandas_udf

            n = self.dimensions

            @pandas_udf("array<float>")
            def embed(texts):
                seen.add(len(texts))
                return texts.map(lambda t: [float(len(t))] * n)

            return embed(text)

    index = Index(spark, str(tmp_path / "db"), Counting(4), cache=cache)
    (tree / "copy1.md").write_text("the same\n")
    index.index(str(tree))
    first, chunks = seen.value, index.read("chunks").count()
    assert first == chunks and cache.table().count() == first
    again = Index(spark, str(tmp_path / "db2"), Counting(4), cache=EmbeddingCache(spark, str(tmp_path / "cache"), buckets=4))
    again.index(str(tree))
    assert seen.value == first and again.read("vectors").count() == chunks

    rows = spark.createDataFrame([("k",)], "key string")
    plan = cache.lookup(rows)._jdf.queryExecution().executedPlan().toString()
    cached = plan[plan.index("embedding_cache") - 2500 :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in cached


def test_eviction(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"), buckets=2)
    for k in range(3):
        cache.put(spark.createDataFrame([(f"k{k}{j}", [1.0, 2.0]) for j in range(2)], "key string, embedding array<float>"))
    own = cache.table().withColumn("used", F.substring("key", 2, 1).cast("long"))
    cache._write(spark.createDataFrame(own.collect(), own.schema), "overwrite")
    cache.touch(spark.createDataFrame([("k00",), ("none",)], "key string"))
    each = cache.table().first().bytes
    cache.evict(3 * each)
    assert sorted(r.key for r in cache.table().collect()) == ["k00", "k20", "k21"]
    cache.evict(each - 1)
    assert cache.table().count() == 0


# ---- lookups


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    at = tmp_path / "tree"
    at.mkdir()
    index = index_at(spark, tmp_path / "db")
    for k in range(3):
        (at / f"f{k}.md").write_text("\n".join(f"line {k} {j}" for j in range(400)))
        index.index(str(at))
    chunk = index.chunk(7)
    assert chunk["chunk_id"] == 7 and index.chunk(10**9) is None
    hold = 0
    for f in (tmp_path / "db/chunks").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = next(meta.row_group(g).column(c).statistics for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "chunk_id")
            hold += bool(stats) and stats.min <= 7 <= stats.max
    assert hold == 1
    plan = index.read("chunks").where("chunk_id IN (1, 7)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(chunk_id, [1,7])" in plan
    rows = search({"local": index}, "line", 3).collect()
    assert len(rows) == 3 and json.loads(json.dumps(rows[0].path))
