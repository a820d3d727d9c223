"""One text of some hundred thousand words among short ones."""

from lodeseek.llm import centroid_search, curriculum, decontaminate, host_quality, ngram_join, toxicity, warc_fixity

N = 300_000
LONG = " ".join(f"w{k % 9973}x{k // 9973}" for k in range(N))
PASSAGE = "the quick brown fox jumps over the lazy dog again and again"


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, f"{LONG} {PASSAGE}"), (2, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.find_matches(docs, bench)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (N + 12, 12, True)
    assert (got[2].n_words, got[2].n_hit, got[2].contaminated) == (N, 0, False)


def test_similar_texts(spark):
    rows = [(1, LONG), (2, LONG + " tail"), (3, " ".join(LONG.split()[: N // 2])), (4, "short text of five words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (N - 4, 1), 2: (N - 3, 1), 3: (N // 2 - 4, 3), 4: (1, 4)}


def test_toxicity(spark):
    rows = [(i, "you stupid idiot" if i % 2 else "a fine day", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    long = spark.createDataFrame([(1, LONG), (2, f"{LONG} you stupid idiot.")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert 0 <= got[1] < got[2] <= 1


def test_host_quality(spark):
    docs = spark.createDataFrame([(1, LONG, "h"), (2, (LONG + "\n") * 2, "h")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in host_quality.judge(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (N, 0, False)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].n_dup_lines, got[2].base_failed) == (2 * N, 2 * N, 1, True)


def test_warc_fixity(spark):
    rows = [(1, "u", LONG), (2, "v", "short")]
    a, b = (warc_fixity.records(spark.createDataFrame(r, "page_id long, url string, html string")) for r in (rows, [(1, "u", LONG[:-1] + "!"), rows[1]]))
    assert [(r.number, r.status) for r in warc_fixity.audit(a, b).collect()] == [(1, "changed")]


def test_mixing(spark):
    got = {r.doc_id: r for r in curriculum.mix(spark.createDataFrame([(1, LONG, "a"), (2, "few words", "b")], "doc_id long, text string, source string")).collect()}
    assert got[1].size == N and got[2].taken == 6 and got[1].taken == N + 2 - 6


def test_many_equal_vectors(spark):
    """A third of all vectors are one."""
    rows = [(i, [1.0, 2.0]) for i in range(5000)] + [(i, [float(i % 7), float(i % 11)]) for i in range(5000, 15000)]
    found, centres = centroid_search.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dimensions=2)
    same = {(r.cluster, r.distance) for r in found.where("id < 5000").collect()}
    assert len(same) == 1 and found.count() == 15000 and len(centres) == 8
