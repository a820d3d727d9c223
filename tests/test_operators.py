import urllib.error
import os

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import changes, chunking, embedding, extractors, fts, ranking, stats, vector_search


def test_windows_and_splits(spark):
    texts = {n: "\n".join(f"l{i}" for i in range(n)) for n in (0, 90, 91, 95, 100, 101, 200)}
    d = spark.createDataFrame(list(texts.items()), "n int, t string")
    got = {}
    for r in chunking.line_windows(d, "t").orderBy("n", "start_line").collect():
        got.setdefault(r.n, []).append((r.start_line, r.end_line))
    assert got == {90: [(0, 90)], 91: [(0, 91), (90, 91)], 95: [(0, 95), (90, 95)], 100: [(0, 100), (90, 100)], 101: [(0, 100), (90, 101)], 200: [(0, 100), (90, 190), (180, 200)]}
    c = spark.createDataFrame([(7, texts[101], "fn f()", "doc"), (0, "é" * 1500, None, None), (3, "short", None, "d")], "start_line int, content string, signature string, docstring string")
    rows = chunking.split_oversized(c).orderBy("start_line", "split_index").collect()
    assert [(r.start_line, r.end_line, r.is_complete, r.split_index) for r in rows] == [(0, 1, False, 0), (3, 4, True, None), (7, 107, False, 0), (97, 108, False, 1)]
    assert rows[0].content == "// [Part 1/1] (continued)\n" + "é" * 1500
    assert rows[2].content.startswith("// [Part 1/2] fn f()\nl0\n") and rows[2].docstring == "doc" and rows[3].docstring is None


def test_gaps_and_contexts(spark):
    d = spark.createDataFrame([("a\nb\nc\nd\ne", [(1, 3)]), ("x\ny", [(0, 2)]), ("p\n\n \nq", [(0, 1), (3, 4)]), ("m\nn", [])], "t string, cov array<struct<start_line:int,end_line:int>>")
    got = sorted((r.start_line, r.end_line, r.content) for r in chunking.gap_chunks(d, "t", "cov").collect())
    assert got == [(0, 1, "a"), (0, 2, "m\nn"), (3, 5, "d\ne")]
    c = spark.createDataFrame([(0, 1), (1, 2), (3, 5), (4, 5)], "start_line int, end_line int").withColumn("t", F.lit("a\nb\nc\nd\ne"))
    rows = chunking.context_windows(c, "t").orderBy("start_line", "end_line").collect()
    assert [(r.context_prev, r.context_next) for r in rows] == [(None, "b\nc\nd"), ("a", "c\nd\ne"), ("a\nb\nc", None), ("b\nc\nd", None)]


def hits(spark, ids, rank):
    return spark.createDataFrame([(i, 1.0 - k / 10, k + 1) for k, i in enumerate(ids)], f"id long, score double, {rank} int")


def test_fusion(spark):
    v, f = hits(spark, [1, 2, 3], "vector_rank"), hits(spark, [2, 1, 4], "keyword_rank")
    got = {r.id: r.score for r in ranking.weighted_rrf(v, f, 0.3).collect()}
    assert got == pytest.approx({2: 0.01631411951348493, 1: 0.016208355367530406, 4: 0.01111111111111111, 3: 0.0047619047619047615})
    assert max(ranking.weighted_rrf(v, f, 0.8).collect(), key=lambda r: r.score).id == 1
    plain = {r.id: r for r in ranking.rrf(v, f, 20.0).collect()}
    assert plain[1].score == pytest.approx(1 / 21 + 1 / 22) and plain[4].vector_rank is None and plain[3].keyword_rank is None
    assert [r.keyword_rank for r in ranking.vector_only(v).collect()] == [None] * 3


def test_blend(spark):
    d = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.5, -10.0)], "id long, score double, raw double")
    got = {r.id: r.blended for r in ranking.blend(d).collect()}
    assert got[1] > 0.57 and got[2] < 0.01
    assert ranking.blend(d.limit(1)).first().blended == pytest.approx(0.575 / (1 + pow(2.718281828459045, -10)))


def test_ranked_rows(spark):
    d = spark.createDataFrame([(1, "./src/a", 0, 5, 0.9), (2, "src/a", 0, 5, 0.9), (3, "src/a", 0, 5, 0.95), (4, "srcx/b", 1, 2, 0.1), (5, "src/a", 7, 9, 0.2)], "id long, path string, start_line int, end_line int, score double")
    assert sorted(r.id for r in ranking.dedup_best(d, ["path", "start_line", "end_line"]).collect()) == [1, 3, 4, 5]
    assert sorted(r.id for r in ranking.path_prefix(d, "./src").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in ranking.path_prefix(d, "src/").collect()) == [1, 2, 3, 5]
    assert sorted(r.id for r in ranking.per_file_cap(d, 1).collect()) == [1, 3, 4]
    keyed = spark.createDataFrame([(0, "z"), (1, "y"), (2, "x"), (3, "y")], "i int, hash string")
    assert [r.hash for r in ranking.dedup_first(keyed, "hash", "i").orderBy("i").collect()] == ["z", "y", "x"]


def test_full_text(spark):
    d = spark.createDataFrame(
        [(1, "hello_world parser", None, ""), (2, "world hello", "fn parse(x)", "API-VERSION 2"), (3, "other text " + "z" * 40, None, "1.0"), (4, "hello world world", None, "")],
        "id long, content string, signature string, literals string",
    )
    fields = {"content": "content", "signature": "signature", "literals": "literals"}
    ask = lambda q, **k: sorted(r.id for r in fts.search(d, "id", fields, q, **k).collect())
    assert ask("hello") == [1, 2, 4] and ask("hello parse") == [2] and ask("hello missing") == []
    assert ask("hello_world") == [1, 4] and ask('"world hello"') == [2]
    assert ask("api-version 2") == [2] and ask("signature:parse") == [2] and ask("nofield:parse") == []
    assert ask("hello -parser") == [2, 4] and ask("parser OR other") == [1, 3] and ask("hello NOT parser") == [2, 4]
    assert ask("foo(hello)") == [] and ask("(hello)") == [1, 2, 4] and ask("") == [] and ask("z" * 40) == []
    assert ask("missing hello", mode="or") == [1, 2, 4]
    assert [r.id for r in fts.search(d, "id", fields, "world", 1).collect()] == [4]


def test_vectors(spark):
    rows = [(i, [float(i == k) for k in range(4)]) for i in range(4)] + [(9, [0.0] * 4)]
    d = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    got = vector_search.top_k(d, [0.9, 0.1, 0.0, 0.0], 3).collect()
    assert [r.id for r in got] == [0, 1, 2] and got[0].score > got[1].score > got[2].score
    with pytest.raises(Exception, match="dimensions"):
        vector_search.top_k(d, [1.0], 3).collect()
    q = spark.createDataFrame([(7, [0.0, 1.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.9, 0.3])], "query_id long, embedding array<float>")
    batch = sorted((r.query_id, r["rank"], r.id) for r in vector_search.batch_top_k(d, q, 2).collect())
    assert batch == [(7, 1, 1), (7, 2, 0), (8, 1, 2), (8, 2, 3)]
    assert vector_search.batch_top_k(d, q.limit(0), 2).collect() == []
    assert vector_search.batch_top_k(d.limit(0), q, 2).collect() == []
    # rows without a vector have no hits; vectors of unlike lengths are no vectors of another length
    holes = d.unionByName(spark.createDataFrame([(20, None)], d.schema))
    assert sorted((r.query_id, r["rank"], r.id) for r in vector_search.batch_top_k(holes, q, 2).collect()) == batch
    for odd in ([(1, [1.0, 2.0, 3.0]), (2, [1.0] * 5)], [(1, [1.0, None, 0.0, 0.0])], [(1, [1.0] * 3)]):
        with pytest.raises(Exception, match="unlike lengths|missing numbers|numbers, queries"):
            vector_search.batch_top_k(spark.createDataFrame(odd, d.schema).coalesce(1), q, 2).collect()


def test_batch_top_k_over_many_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(40, 8)).astype(np.float32)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_search, "ROW_BLOCK", 33)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>").repartition(3)
    near = (q @ m.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1))
    got = {}
    for r in vector_search.batch_top_k(rows, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: np.argsort(-near[i])[:5].tolist() for i in range(40)}


def test_approximate_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    recall = []
    for q in v.where("vec_id % 100 = 0").collect():
        exact = {r.id for r in vector_search.top_k(v, list(q.embedding), 10, "vec_id").collect()}
        recall.append(len(exact & {r.id for r in vector_search.approximate_top_k(v, list(q.embedding), 10, "vec_id").collect()}) / 10)
    assert sum(recall) / len(recall) >= 0.9


def test_changes(spark):
    s = "path string, hash string, mtime long, size long"
    old = spark.createDataFrame([("same", "a", 1, 1), ("touch", "b", 1, 1), ("edit", "c", 1, 1), ("gone", "d", 1, 1)], s)
    new = spark.createDataFrame([("same", "a", 1, 1), ("touch", "b", 2, 1), ("edit", "x", 2, 1), ("fresh", "e", 1, 1)], s)
    assert {r.path: r.status for r in changes.change_detect(old, new).collect()} == {"same": "unchanged", "touch": "unchanged", "edit": "changed", "gone": "deleted", "fresh": "new"}
    ids = changes.with_ids(spark.createDataFrame([(c,) for c in "qwertyuiopasdf"], "c string").repartition(4), ["c"], 5)
    assert [(r.c, r.chunk_id) for r in ids.orderBy("c").collect()] == [(c, k + 5) for k, c in enumerate(sorted("qwertyuiopasdf"))]
    both = changes.upsert(old, new.where("path = 'edit'"), "path")
    assert {r.path: r.hash for r in both.collect()}["edit"] == "x" and both.count() == 4


def test_embedding(spark, monkeypatch):
    assert embedding.model().short == "minilm-l6-q" and embedding.model("bge-large").dimensions == 1024 and len(embedding.MODELS) == 16
    with pytest.raises(ValueError):
        embedding.model("nothing")
    assert [embedding.token_budget(d) for d in (384, 768, 1024)] == [10000, 5000, 3750] and embedding.token_budget(384, 4) == 1000
    monkeypatch.setenv("LODESEEK_TOKEN_BUDGET", "77")
    assert embedding.token_budget(384) == 77
    d = spark.createDataFrame([("a b c",), ("",), ("b é",)], "t string")
    a, b = embedding.HashingEmbedder(16), embedding.HashingArrowEmbedder(16)
    for r in d.select(a.column(F.col("t")).alias("a"), b.column(F.col("t")).alias("b")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-6)
    assert embedding.truncate_utf8("héllo", 2) == "h"
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([4, 400, 40, 8, 80])], "i int, t string").coalesce(1)
    batches = {}
    for r in embedding.budget_batches(rows, "t", 40, "i").collect():
        batches.setdefault(r.batch, []).append(len(r.t))
    assert batches == {0: [4, 8, 40], 1: [80], 2: [400]}
    assert stats.embed_stats(100, 80, 20, 1000) == {"hit_rate": 0.2, "success_rate": 0.8, "chunks_per_second": 80.0}
    assert stats.embed_stats(0, 0, 0, 0)["hit_rate"] == 0


def test_http_embedder_cuts_long_texts():
    import io

    seen = []

    def opener(request):
        seen.append(len(request.data))
        if len(seen) < 3:
            raise urllib.error.HTTPError("u", 500, "error", None, io.BytesIO(b"the input exceeds the context length"))
        return io.BytesIO(b'{"embedding": [1.0, 2.0]}')

    assert embedding.HttpEmbedder(context=100).fetch("y" * 5000, opener) == [1.0, 2.0]
    assert seen[0] > seen[1] > seen[2]

    # a lost connection or another refusal cuts nothing
    for failure in (ConnectionRefusedError(), TimeoutError(), urllib.error.HTTPError("u", 500, "error", None, io.BytesIO(b"out of memory"))):
        tries = []

        def fails(request, failure=failure, tries=tries):
            tries.append(request)
            raise failure

        with pytest.raises(OSError):
            embedding.HttpEmbedder(context=100).fetch("y" * 5000, fails)
        assert len(tries) == 1


def test_cached_embeddings(spark):
    s = "chunk_id long, context array<string>, signature string, docstring string, content string, hash string"
    c = spark.createDataFrame([(i, [], None, None, t, t) for i, t in enumerate(["a", "b", "a"])], s)
    cache = spark.createDataFrame([("b", [9.0])], "hash string, embedding array<float>")
    got = {r.chunk_id: r.embedding for r in embedding.embed_chunks(c, embedding.HashingEmbedder(4), cache).collect()}
    assert got[1] == [9.0] and got[0] == got[2] and len(got) == 3


def test_extractors(spark):
    got = {}
    for r in extractors.definitions(spark.createDataFrame(extractors.SAMPLES, "path string, language string, content string")).collect():
        got.setdefault(r.path, {})[r.name] = r
    kinds = {p: {n: r.kind for n, r in d.items()} for p, d in got.items()}
    assert kinds["a.py"] == {"A": "Class", "m": "Method", "f": "Function"} and got["a.py"]["A"].docstring == '"""Doc."""' and got["a.py"]["m"].signature == "def m(self, x: int) -> str"
    assert kinds["b.rs"] == {"add": "Function", "P": "Struct", None: "Impl", "new": "Method"} and got["b.rs"]["add"].signature == "fn add<T>(a: T, b: T) -> T" and got["b.rs"]["add"].docstring == "/// Adds."
    assert kinds["c.ts"] == {"go": "Function", "C": "Class", "run": "Method", "k": "Function"} and got["c.ts"]["go"].docstring == "/** Doc */"
    assert kinds["d.cs"] == {"N": "Mod", "D": "Class", "Add": "Method"} and kinds["e.go"] == {"F": "Function", "M": "Method", "R": "Struct"}
    assert kinds["f.java"] == {"J": "Class", "m": "Method"} and kinds["g.c"]["add"] == "Function" and kinds["g.c"]["S"] == "Struct"
    assert kinds["h.rb"] == {"M": "Mod", "K": "Class", "go": "Method"} and (got["h.rb"]["go"].start_line, got["h.rb"]["go"].end_line) == (3, 8)
    assert kinds["i.php"] == {"go": "Function", "K": "Class", "m": "Method"} and kinds["j.sh"] == {"run": "Function"} and got["j.sh"]["run"].end_line == 4
    assert kinds["k.sql"] == {"t": "Struct", "f": "Function"} and got["l.sql"]["m"].kind == "Function"
    assert got["c.ts"]["run"].context == ["File: c.ts", "Class: C", "Method: run"]
    assert extractors.macros("a\n{% macro x(a, b) %}\n1\n") == [("x", "a, b", 1, 11)]
    d = spark.createDataFrame([("{{ config(a=1) }} {{ source('s', 't') }}",)], "t string").select(extractors.dbt_sources(F.col("t")).alias("s"), extractors.dbt_config(F.col("t")).alias("c")).first()
    assert d.s == ["s.t"] and d.c == "a=1"


def test_statistics(spark):
    c = spark.createDataFrame([("same", "local", "p"), ("same", "global", "q"), ("same", "global", "q"), ("different", "local", "p")], "hash string, db string, path string")
    assert stats.dedup_stats(c).first().asDict() == {"total": 4, "unique": 2, "duplicates": 2, "ratio": 0.5}
    both = stats.combined_stats(c).first()
    assert (both.total_chunks, both.total_files, both.local_chunks, both.global_files, both.indexed) == (4, 2, 2, 1, True)
    answers = spark.createDataFrame([("q", "a", "src/a.rs", 0.9, False), ("r", "b", "x", 0.5, False), ("n", "", "y", 0.4, True)], "query string, expected string, found string, score double, is_negative boolean")
    assert stats.retrieval_eval(answers).first().asDict() == {"accuracy": 0.5, "avg_score": 0.7, "false_positive_score": 0.4}
    assert os.environ["PYARROW_IGNORE_TIMEZONE"] == "1"


def test_postings_with_and_without_a_shuffle(spark):
    rows = [(1, "b a B c a", "x y"), (2, None, "x"), (3, "", ""), (4, "é日本 7 " + "z" * 50, None), (5, " ".join(f"w{i % 9}" for i in range(300)), "w1 w1")]
    d = spark.createDataFrame(rows, "id long, text string, path string")
    both = [sorted((r.field, r.term, r.id, r.tf, tuple(r.positions)) for r in f(d, "id", {"text": "text", "path": "path"}).collect()) for f in (fts.postings, fts.all_postings)]
    assert both[0] == both[1] and len(both[0]) > 15


def test_nearest_holds_few_scores_at_a_time(spark, monkeypatch):
    """Equal scores across strips, in order of id; no product holds more than SCORES numbers."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vector_search, "SCORES", 40)
    held, real = [], np.outer
    monkeypatch.setattr(vector_search.np, "outer", lambda a, b: held.append(len(a) * len(b)) or real(a, b))
    rng = np.random.default_rng(3)
    v, q, ids = rng.integers(-1, 2, (20, 3)).astype(np.float32), rng.integers(-1, 2, (9, 3)).astype(np.float32), rng.permutation(20)
    row = [pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([3], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([list(range(9))], pa.list_(pa.int64())), pa.array([3], pa.int32()), pa.array([q.tobytes()], pa.binary())]
    got = [(r["query_id"], r["id"]) for b in vector_search._nearest([pa.RecordBatch.from_arrays(row, names=list("abcdef"))], 4) for r in b.to_pylist()]
    scale = np.outer(np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(v.astype(float), axis=1))
    near = np.divide(q.astype(float) @ v.T, scale, out=np.zeros_like(scale), where=scale > 0)
    assert got == [(i, ids[j]) for i in range(9) for j in np.lexsort((ids, -near[i]))[:4]]
    assert max(held[:-1]) <= 40


def test_counted_postings_are_all_postings(spark):
    d = spark.createDataFrame([(1, "b a B c a", "x/a"), (2, None, ""), (3, "é 1 É", None)], "id long, text string, path string")
    both = [sorted(map(tuple, p.select("field", "term", "id", "tf", "dl").collect())) for p in (f(d, "id", {"text": "text", "path": "path"}) for f in (fts.all_postings, fts.counted_postings))]
    assert both[0] == both[1] and len(both[0]) == 7


def test_blocks_are_made_once_before_they_meet(spark):
    """Both sides of the meeting come from a shuffle; the nearest are those of one query after another."""
    import random

    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(120)], "id long, embedding array<float>").repartition(3)
    asked = rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        near = vector_search.batch_top_k(rows, asked, 4)
        plan = near._jdf.queryExecution().sparkPlan().toString()
        sides = plan[plan.index("CartesianProduct") :].split("MapInArrow")
        assert [" Exchange " in " ".join(x.split()) or "Exchange hashpartitioning" in x for x in sides[:2]] == [True, True]
        got = {}
        for r in near.orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {q.query_id: [r.id for r in vector_search.top_k(rows, q.embedding, 4).collect()] for q in asked.collect()}
