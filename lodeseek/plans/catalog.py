"""The registered queries of the retrieval engine, each over whole tables, each with its SQL twin.

Joining documents and embeddings by their ids is synthetic: the test tables share nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import changes, chunking, embedding, extractors, fts, ranking, stats, vector_search
from ..sources import languages as L

_Q: dict = {}
_SQL: dict[str, str] = {}
KEYWORDS = "license version"


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from . import catalog_stored  # noqa: F401  registers its queries here

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import catalog_stored  # noqa: F401

    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(vectors: DataFrame) -> list[float]:
    """The vector of the least id: the query of the single-query searches."""
    return list(vectors.orderBy("vec_id").select("embedding").first()[0])


# ---- vectors

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NEAR = f"SELECT e.vec_id AS id, {_COS} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query("vector_topk", f"SELECT id, round(cosine, 6) AS cosine, round((1 + cosine) / 2, 6) AS score FROM ({_NEAR}) ORDER BY cosine DESC, id LIMIT 10")
def vector_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return vector_search.top_k(v, first_vector(v), 10, "vec_id").select("id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


_BATCH = f"""SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS cosine,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"""


@query("vector_topk_batch", f"SELECT query_id, id, round(cosine, 6) AS cosine, rank::INT AS rank FROM ({_BATCH}) WHERE rank <= 10")
def vector_topk_batch(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.batch_top_k(v, q, 10, "vec_id").select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query("knn_per_label", f"SELECT label, id, round(cosine, 6) AS cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, id) AS rank FROM (SELECT n.*, label FROM ({_NEAR}) n JOIN embeddings ON id = vec_id)) WHERE rank <= 3")
def knn_per_label(spark, sf):
    from pyspark.sql import Window

    v = table(spark, sf, "embeddings")
    q = F.array(*(F.lit(x) for x in first_vector(v)))
    near = v.select("label", F.col("vec_id").alias("id"), V.cosine(F.col("embedding"), q).alias("cosine"))
    w = Window.partitionBy("label").orderBy(F.desc("cosine"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 3").withColumn("cosine", F.round("cosine", 6))


@query("lsh_topk")
def lsh_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return vector_search.approximate_top_k(v, first_vector(v), 10, "vec_id")


# ---- full text

_TOK = r"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+'), lambda x: strlen(x) < 40)"
_DOC_TOKENS = f"SELECT doc_id AS id, 'text' AS field, unnest({_TOK.format(c='text')}) AS term FROM documents"


@query("fts_token_stats", f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM ({_DOC_TOKENS}) GROUP BY term")
def fts_token_stats(spark, sf):
    post = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(T.tokens("text")).alias("term"))
    per = post.groupBy("term", "id").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("fts_doc_len", f"SELECT doc_id AS id, 'text' AS field, len({_TOK.format(c='text')})::BIGINT AS dl FROM documents")
def fts_doc_len(spark, sf):
    return fts.lengths(table(spark, sf, "documents"), "doc_id", {"text": "text"})


@query("fts_postings", f"SELECT field, term, id, count(*) AS tf FROM ({_DOC_TOKENS}) GROUP BY ALL")
def fts_postings(spark, sf):
    return fts.all_postings(table(spark, sf, "documents"), "doc_id", {"text": "text"}).select("field", "term", "id", "tf")


def bm25_sql(source: str, id_col: str, fields: dict[str, str], terms: list[str]) -> str:
    """AND over the terms, sum over fields."""
    union = " UNION ALL ".join(f"SELECT {id_col} AS id, '{n}' AS field, {_TOK.format(c=c)} AS toks FROM {source}" for n, c in fields.items())
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH d AS ({union}), s AS (SELECT field, count(*) AS n, avg(len(toks)) AS avgdl FROM d GROUP BY field),
t AS (SELECT id, field, len(toks) AS dl, unnest(toks) AS term FROM d),
p AS (SELECT id, field, term, any_value(dl) AS dl, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY id, field, term),
f AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
w AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM p JOIN f USING (field, term) JOIN s USING (field))
SELECT id, sum(s) AS score FROM w GROUP BY id HAVING count(DISTINCT term) = {len(terms)}"""


_BM25 = bm25_sql("documents", "doc_id", {"text": "text"}, KEYWORDS.split())


def keyword_hits(spark, sf):
    return fts.search(table(spark, sf, "documents"), "doc_id", {"text": "text"}, KEYWORDS)


@query("fts_bm25_and", f"SELECT id, round(score, 6) AS score FROM ({_BM25})")
def fts_bm25_and(spark, sf):
    return keyword_hits(spark, sf).withColumn("score", F.round("score", 6))


@query("fts_bm25_multifield", f"SELECT id, round(score, 6) AS score FROM ({bm25_sql('pages', 'page_id', {'url': 'url', 'html': 'html'}, ['example', 'org', 'the'])})")
def fts_bm25_multifield(spark, sf):
    return fts.search(table(spark, sf, "pages"), "page_id", {"url": "url", "html": "html"}, "example org the").withColumn("score", F.round("score", 6))


@query(
    "fts_phrase",
    f"""WITH t AS (SELECT doc_id AS id, {_TOK.format(c="text")} AS toks FROM documents), n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
    h AS (SELECT id, len(toks) AS dl, len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'apache' AND toks[i + 1] = 'license')) AS tf FROM t),
    f AS (SELECT count(*) AS df FROM h WHERE tf > 0)
    SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h, n, f WHERE tf > 0""",
)
def fts_phrase(spark, sf):
    return fts.search(table(spark, sf, "documents"), "doc_id", {"text": "text"}, '"Apache License"').withColumn("score", F.round("score", 6))


# ---- fusion

_LISTS = f"""v AS (SELECT id, (1 + cosine) / 2 AS vector_score, row_number() OVER (ORDER BY cosine DESC, id) AS vector_rank FROM ({_NEAR}) QUALIFY vector_rank <= 200),
k AS (SELECT id, score AS keyword_score, row_number() OVER (ORDER BY score DESC, id) AS keyword_rank FROM ({_BM25}) QUALIFY keyword_rank <= 200)"""


def _fused_sql(a: str, b: str) -> str:
    return f"""WITH {_LISTS} SELECT id, vector_rank::INT AS vector_rank, keyword_rank::INT AS keyword_rank, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score,
    round(coalesce({a} / (60.0 + vector_rank), 0) + coalesce({b} / (60.0 + keyword_rank), 0), 9) AS score FROM v FULL OUTER JOIN k USING (id)"""


def both_lists(spark, sf):
    v = table(spark, sf, "embeddings")
    near = vector_search.top_k(v, first_vector(v), 200, "vec_id")
    return ranking.ranked(near, "vector_rank"), ranking.ranked(keyword_hits(spark, sf), "keyword_rank")


def _shown(d: DataFrame) -> DataFrame:
    return d.select("id", "vector_rank", "keyword_rank", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), F.round("score", 9).alias("score"))


@query("rrf_fusion", _fused_sql("1.0", "1.0"))
def rrf_fusion(spark, sf):
    return _shown(ranking.rrf(*both_lists(spark, sf)))


@query("weighted_rrf", _fused_sql("0.3", "0.7"))
def weighted_rrf(spark, sf):
    return _shown(ranking.weighted_rrf(*both_lists(spark, sf), 0.3))


@query("vector_only_rank", f"WITH {_LISTS} SELECT id, vector_rank::INT AS vector_rank, round(vector_score, 6) AS score FROM v")
def vector_only_rank(spark, sf):
    return ranking.vector_only(both_lists(spark, sf)[0]).select("id", "vector_rank", F.round("score", 6).alias("score"))


_HYBRID = f"SELECT id, score FROM ({_fused_sql('0.5', '0.5')}) ORDER BY score DESC, id LIMIT 25"


@query("hybrid_search", f"SELECT h.id, h.score, d.source AS path, d.lang AS kind FROM ({_HYBRID}) h JOIN documents d ON h.id = d.doc_id")
def hybrid_search(spark, sf):
    """Classify, fuse both lists, take the best, and only then fetch what is shown."""
    alpha = T.ALPHA["Hybrid"]  # two words, no marker
    top = _shown(ranking.weighted_rrf(*both_lists(spark, sf), alpha)).select("id", "score").orderBy(F.desc("score"), "id").limit(25)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("kind"))
    return docs.join(F.broadcast(top), "id").select("id", "score", "path", "kind")  # 25 rows


@query(
    "rerank_blend",
    f"""WITH top AS (SELECT id, score FROM ({_fused_sql('0.5', '0.5')}) ORDER BY score DESC, id LIMIT 50),
    r AS (SELECT id, score, len(list_intersect(list_distinct({_TOK.format(c='text')}), ['license', 'version'])) * 2 - 2.0 AS raw FROM top JOIN documents ON id = doc_id),
    e AS (SELECT min(score) AS low, max(score) AS high FROM r)
    SELECT id, raw::DOUBLE AS raw, round(0.575 / (1 + exp(-raw)) + 0.425 * (score - low) / greatest(high - low, 0.0001), 6) AS blended FROM r, e""",
)
def rerank_blend(spark, sf):
    top = _shown(ranking.weighted_rrf(*both_lists(spark, sf), 0.5)).select("id", "score").orderBy(F.desc("score"), "id").limit(50)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = docs.join(F.broadcast(top), "id").withColumn("raw", embedding.lexical_scorer(KEYWORDS)(F.col("text")))
    return ranking.blend(rows).select("id", "raw", F.round("blended", 6).alias("blended"))


def _db_sql(where: str, db: str) -> str:
    return f"SELECT '{db}' AS db, id, round(score, 6) AS score FROM ({bm25_sql(f'(SELECT * FROM documents WHERE {where})', 'doc_id', {'text': 'text'}, KEYWORDS.split())}) ORDER BY score DESC, id LIMIT 50"


@query("multi_db_search", f"SELECT * FROM ({_db_sql(chr(34) + 'source' + chr(34) + ' = ' + chr(39) + 'src0' + chr(39), 'local')}) UNION ALL SELECT * FROM ({_db_sql(chr(34) + 'source' + chr(34) + ' <> ' + chr(39) + 'src0' + chr(39), 'global')})")
def multi_db_search(spark, sf):
    docs = table(spark, sf, "documents")
    parts = []
    for db, own in (("local", docs.where("source = 'src0'")), ("global", docs.where("source <> 'src0'"))):
        parts.append(fts.search(own, "doc_id", {"text": "text"}, KEYWORDS).select(F.lit(db).alias("db"), "id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50))
    return parts[0].unionByName(parts[1])


@query("dedup_best", "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def dedup_best(spark, sf):
    return ranking.dedup_best(table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "n_chars", "doc_id")


@query("per_file_cap", "SELECT source, doc_id, n_chars, max(n_chars) OVER (PARTITION BY source) AS file_score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def per_file_cap(spark, sf):
    return ranking.per_file_cap(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), 3, "source", "n_chars", "doc_id")


@query("path_prefix_filter", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def path_prefix_filter(spark, sf):
    return ranking.path_prefix(table(spark, sf, "pages").select("page_id", "url"), "./https://", "url")


@query("path_contains_filter", "SELECT * FROM (SELECT page_id, url, strlen(html)::BIGINT AS score FROM pages ORDER BY score DESC, page_id LIMIT 100) WHERE contains(url, 'example.org')")
def path_contains_filter(spark, sf):
    """After the limit, as the contract of the service has it."""
    d = table(spark, sf, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("score"))
    return ranking.path_contains(d.orderBy(F.desc("score"), "page_id").limit(100), "example.org", "url")


@query("compact_paths", "SELECT source, min(rank) AS best_rank FROM (SELECT source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 200) GROUP BY source")
def compact_paths(spark, sf):
    top = ranking.ranked(table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score")), "rank")
    return ranking.compact(top, "source").withColumn("best_rank", F.col("best_rank").cast("long"))


# ---- query classes

_TEXTS = "SELECT text AS q FROM benchmark UNION ALL SELECT text FROM conversations UNION ALL SELECT url FROM pages UNION ALL SELECT source || ' ' || lang FROM documents UNION ALL SELECT text FROM documents"
_MARKS = ", ".join(f"'{w}'" for w in T.QUESTION_WORDS)
_KIND = rf"""CASE WHEN len(w) = 1 THEN 'Keyword' WHEN list_has_any(list_transform(w, lambda x: lower(x)), [{_MARKS}]) THEN 'Semantic'
  WHEN contains(q, '::') OR contains(q, '()') OR contains(q, '->') OR contains(q, '=>') THEN 'Keyword' WHEN contains(q, '<') AND contains(q, '>') THEN 'Keyword'
  WHEN NOT contains(q, ' ') AND ((regexp_matches(q, '\p{{Lu}}') AND regexp_matches(q, '\p{{Ll}}')) OR contains(q, '_')) THEN 'Keyword'
  WHEN len(w) <= 3 THEN 'Hybrid' WHEN len(w) >= 5 THEN 'Semantic' ELSE 'Hybrid' END"""
_CLASSED = rf"SELECT q, {_KIND} AS kind FROM (SELECT q, regexp_extract_all(q, '[^ \t\n\x0b\f\r]+') AS w FROM ({_TEXTS}))"


def _query_texts(spark, sf):
    t = lambda n: table(spark, sf, n)
    parts = [t("benchmark").select(F.col("text").alias("q")), t("conversations").select("text"), t("pages").select("url"), t("documents").select(F.concat_ws(" ", "source", "lang")), t("documents").select("text")]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every


@query("classify_query", _CLASSED)
def classify_query(spark, sf):
    return _query_texts(spark, sf).select("q", T.classify_query("q").alias("kind"))


@query("query_alpha", f"SELECT kind, CASE kind WHEN 'Keyword' THEN 0.3 WHEN 'Semantic' THEN 0.8 ELSE 0.5 END::DOUBLE AS alpha, count(*) AS n FROM ({_CLASSED}) GROUP BY kind")
def query_alpha(spark, sf):
    d = _query_texts(spark, sf).select(T.classify_query("q").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return d.select("kind", T.query_alpha("kind").alias("alpha"), "n")


# ---- chunks

_LINES = r"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace({c}, '\n\z', ''), '\r?\n') END"


def _windows_sql(size: int, stride: int) -> str:
    return f"""SELECT doc_id, s AS start_line, least(s + {size}, len(l))::INT AS end_line, array_to_string(l[s + 1:least(s + {size}, len(l))], chr(10)) AS content, l
    FROM (SELECT doc_id, l, unnest(range(0, len(l), {stride}))::INT AS s FROM (SELECT doc_id, {_LINES.format(c='text')} AS l FROM documents))"""


@query("line_window_chunks", f"SELECT doc_id, start_line, end_line, sha256(content) AS hash FROM ({_windows_sql(100, 90)})")
def line_window_chunks(spark, sf):
    return chunking.line_windows(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "start_line", "end_line", "hash")


@query("line_windows_small", f"SELECT doc_id, start_line, end_line, sha256(content) AS hash FROM ({_windows_sql(5, 4)})")
def line_windows_small(spark, sf):
    return chunking.line_windows(table(spark, sf, "documents").select("doc_id", "text"), "text", 5, 1).select("doc_id", "start_line", "end_line", "hash")


@query(
    "context_windows",
    f"""SELECT doc_id, start_line, end_line, CASE WHEN trim(translate(p, chr(10) || chr(9), '  ')) <> '' THEN p END AS context_prev, CASE WHEN trim(translate(n, chr(10) || chr(9), '  ')) <> '' THEN n END AS context_next
    FROM (SELECT *, array_to_string(l[greatest(start_line - 3, 0) + 1:start_line], chr(10)) AS p, array_to_string(l[end_line + 1:end_line + 3], chr(10)) AS n FROM ({_windows_sql(5, 4)}))""",
)
def context_windows(spark, sf):
    d = chunking.line_windows(table(spark, sf, "documents").select("doc_id", "text"), "text", 5, 1)
    return chunking.context_windows(d, "text").select("doc_id", "start_line", "end_line", "context_prev", "context_next")


@query(
    "split_oversized",
    f"""WITH l AS (SELECT doc_id, source, text, {_LINES.format(c='text')} AS l FROM documents),
    b AS (SELECT *, len(l) > 20 OR strlen(text) > 2000 AS big FROM l), p AS (SELECT doc_id, source, text, l, big, unnest(CASE WHEN big THEN range(0, len(l), 18) ELSE [0] END)::INT AS s FROM b),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts, CASE WHEN big THEN array_to_string(l[s + 1:s + 20], chr(10)) ELSE text END AS body FROM p)
    SELECT doc_id, s AS start_line, (CASE WHEN big THEN least(s + 20, len(l)) ELSE len(l) END)::INT AS end_line, NOT big AS is_complete, (CASE WHEN big THEN s // 18 END)::INT AS split_index, sha256(body) AS hash,
      sha256(CASE WHEN big THEN '// [Part ' || (s // 18 + 1) || '/' || parts || '] ' || source || chr(10) || body ELSE body END) AS content_sha FROM n""",
)
def split_oversized(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("start_line"), F.col("text").alias("content"), F.col("source").alias("signature"), F.lit(None).cast("string").alias("docstring"))
    return chunking.split_oversized(d, 20, 2000, 2).select("doc_id", "start_line", "end_line", "is_complete", "split_index", "hash", F.sha2("content", 256).alias("content_sha"))


@query(
    "gap_chunks",
    rf"""WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {_LINES.format(c='text')} AS l FROM documents)),
    u AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE NOT (i = 1 OR i BETWEEN 4 AND 6))
    SELECT doc_id, min(i)::INT AS start_line, (max(i) + 1)::INT AS end_line, string_agg(line, chr(10) ORDER BY i) AS content, 'Block' AS kind FROM u GROUP BY doc_id, island HAVING bool_or(regexp_matches(line, '[^ \t\x0b\f\r]'))""",
)
def gap_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn("covered", F.expr("array(named_struct('start_line', 4, 'end_line', 7), named_struct('start_line', 1, 'end_line', 2), named_struct('start_line', 5, 'end_line', 6))"))
    return chunking.gap_chunks(d, "text", "covered").select("doc_id", "start_line", "end_line", "content", "kind")


@query("content_hash", "SELECT doc_id, sha256(text) AS hash, strlen(text)::BIGINT AS size_bytes FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("hash_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY sha256(text)")
def hash_dedup(spark, sf):
    return ranking.dedup_first(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), "hash", "doc_id")


@query("dedup_stats", 'SELECT count(*) AS total, count(DISTINCT sha256(text)) AS "unique", count(*) - count(DISTINCT sha256(text)) AS duplicates, round((count(*) - count(DISTINCT sha256(text))) / count(*), 6) AS ratio FROM documents')
def dedup_stats(spark, sf):
    return stats.dedup_stats(table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash")))


_LIT = T.LITERAL.replace("*+", "*").replace("'", "''")
_CLOSED = _LIT.rsplit("|", 1)[0]


@query(
    "string_literals",
    rf"""SELECT page_id, list_filter(list_transform(list_filter(regexp_extract_all(html, '{_LIT}'), lambda x: regexp_full_match(x, '{_CLOSED}')),
      lambda x: regexp_replace(x[2:-2], '\\([\s\S])', '\1', 'g')), lambda x: trim(translate(x, chr(9) || chr(10) || chr(13), '   ')) <> '' AND strlen(x) < 100) AS literals FROM pages""",
)
def string_literals(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.string_literals("html").alias("literals"))


_CLEAN = rf"array_to_string(list_filter(list_transform({_LINES.format(c='{c}')}, lambda x: trim(regexp_replace(trim(translate(x, chr(9), ' ')), '\A(?:///|//!|//|\*|\")', ''))), lambda x: x <> ''), ' ')"


@query("clean_docstring", "SELECT doc_id, " + _CLEAN.format(c="trim(text)") + " AS doc FROM documents")
def clean_docstring(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_docstring("text").alias("doc"))


@query("prepare_text", "SELECT doc_id, sha256('Context: ' || lang || ' > ' || source || chr(10) || 'Signature: ' || source || chr(10) || CASE WHEN doc <> '' THEN 'Documentation: ' || doc || chr(10) ELSE '' END || 'Code:' || chr(10) || text) AS sha FROM (SELECT *, " + _CLEAN.format(c="trim(text)") + " AS doc FROM documents)")
def prepare_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.prepare_text(F.array("lang", "source"), "source", "text", "text"), 256).alias("sha"))


@query("token_estimate", "SELECT doc_id, ceil(strlen(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


_BUDGET = "greatest(1000, least(50000, trunc(10000 * 384 / dimensions)))::BIGINT"
_MODELS = ", ".join(f"('{m[0]}', {m[2]})" for m in embedding.MODELS)


@query(
    "token_budget",
    f"""SELECT short, dimensions, {_BUDGET} AS budget, sum(vectors)::BIGINT AS vectors FROM (
      SELECT short, coalesce(wide, own)::INT AS dimensions, vectors FROM (SELECT len(embedding) AS own, count(*) AS vectors FROM embeddings WHERE len(embedding) > 0 GROUP BY own),
        (SELECT '' AS short, NULL AS wide UNION ALL SELECT * FROM (VALUES {_MODELS}) AS m(short, wide))) GROUP BY short, dimensions""",
)
def token_budget(spark, sf):
    """The budget of the table's own vector lengths, and of each model if it embedded the table."""
    own = table(spark, sf, "embeddings").where("size(embedding) > 0").groupBy(F.size("embedding").alias("own")).agg(F.count("*").alias("vectors"))
    models = F.explode(F.array(*(F.struct(F.lit(s).alias("short"), F.lit(w).cast("int").alias("wide")) for s, w in [("", None), *((m[0], m[2]) for m in embedding.MODELS)])))
    d = own.select("own", "vectors", models.alias("m")).select("m.short", F.coalesce("m.wide", "own").alias("dimensions"), "vectors")
    return d.groupBy("short", "dimensions").agg(F.sum("vectors").alias("vectors")).withColumn("budget", embedding.token_budgets(F.col("dimensions")))


@query(
    "token_batches",
    f"""WITH RECURSIVE d AS (SELECT doc_id, ceil(strlen(text) / 4)::BIGINT AS t, row_number() OVER (ORDER BY strlen(text), doc_id) AS k FROM documents),
    g AS (SELECT doc_id, k, 1 AS n, 0::BIGINT AS batch FROM d WHERE k = 1 UNION ALL
      SELECT d.doc_id, d.k, CASE WHEN d.t * (g.n + 1) > {embedding.token_budget(384)} THEN 1 ELSE g.n + 1 END, g.batch + (d.t * (g.n + 1) > {embedding.token_budget(384)})::INT FROM g JOIN d ON d.k = g.k + 1)
    SELECT doc_id, batch FROM g""",
)
def token_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return embedding.budget_batches(d, "text", embedding.token_budget(384), "doc_id").select("doc_id", "batch")


@query("snippets", f"SELECT doc_id, CASE WHEN length(s) > 100 THEN left(s, 100) || '...' ELSE s END AS snippet, CASE WHEN strlen(text) > 200 THEN left(text, 200) || '...' ELSE text END AS content FROM (SELECT doc_id, text, array_to_string(({_LINES.format(c='text')})[1:3], ' ') AS s FROM documents)")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet("text").alias("snippet"), T.truncated("text").alias("content"))


@query("chunk_ids", "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS chunk_id FROM documents")
def chunk_ids(spark, sf):
    return changes.with_ids(table(spark, sf, "documents").select("source", "doc_id"), ["source", "doc_id"], 1)


# ---- files

_EXT = r"lower(regexp_extract({c}, '[^/]\.([^./]*)\z', 1))"
_PATHS = "SELECT url AS path FROM pages UNION ALL SELECT url || '.' || e FROM pages, (VALUES ('rs'), ('PY'), ('tsx'), ('lock'), ('png'), ('min.js'), ('unknown'), ('sql'), ('h')) AS x(e) UNION ALL SELECT '/root/node_modules/' || page_id || '.js' FROM pages UNION ALL SELECT '/src/outer/' || page_id || '/.git/config' FROM pages"


def _paths(spark, sf):
    p = table(spark, sf, "pages")
    kinds = F.explode(F.array(*map(F.lit, ["rs", "PY", "tsx", "lock", "png", "min.js", "unknown", "sql", "h"])))
    return (
        p.select(F.col("url").alias("path"))
        .union(p.select("url", kinds.alias("e")).select(F.concat_ws(".", "url", "e")))
        .union(p.select(F.concat(F.lit("/root/node_modules/"), "page_id", F.lit(".js"))))
        .union(p.select(F.concat(F.lit("/src/outer/"), "page_id", F.lit("/.git/config"))))
    )


_LANG_CASE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in L.LANGUAGE_OF.items()) + " ELSE 'Unknown' END"


@query("language_map", f"SELECT path, {_LANG_CASE} AS language FROM (SELECT path, {_EXT.format(c='path')} AS ext FROM ({_PATHS}))")
def language_map(spark, sf):
    return _paths(spark, sf).select("path", L.language(F.col("path")).alias("language"))


@query("excluded_dir", "SELECT path, list_has_any(string_split(path, '/'), [" + ", ".join(f"'{x}'" for x in L.EXCLUDED_DIRS) + f"]) AS excluded FROM ({_PATHS})")
def excluded_dir(spark, sf):
    return _paths(spark, sf).select("path", L.in_excluded_dir(F.col("path")).alias("excluded"))


@query("binary_ext", f"SELECT path, {_EXT.format(c='path')} IN (" + ", ".join(f"'{x}'" for x in L.BINARY_EXTENSIONS) + f") AS is_binary FROM ({_PATHS})")
def binary_ext(spark, sf):
    return _paths(spark, sf).select("path", L.binary_by_extension(F.col("path")).alias("is_binary"))


_DBT_OWN = ["select * from {{ ref('a') }} join {{ ref( \"b\" ) }}", "{% macro x() %}", "{{ x }}", "{{ config (m) }}", "ref(a)", "{{source('s', 't')}}", "{{- ref('p', 'm_2') -}} {{ ref('v', v=2) }} {{ ref(x) }}"]
_DBT_TEXTS = "SELECT html AS t FROM pages UNION ALL SELECT html || x FROM pages, (VALUES " + ", ".join("('" + t.replace("'", "''") + "')" for t in _DBT_OWN) + ") AS v(x)"


@query("dbt_detect", f"SELECT t, (contains(t, '{{%') AND contains(t, '%}}')) OR (contains(t, '{{{{') AND contains(t, '}}}}') AND regexp_matches(t, '(ref|source|config) ?\\(')) AS dbt FROM ({_DBT_TEXTS})")
def dbt_detect(spark, sf):
    return _dbt_texts(spark, sf).select("t", L.is_dbt(F.col("t")).alias("dbt"))


_QUOTES = r"""'''"'"""
# taken apart at braces, brackets and commas
_DBT_CALLS = r"list_transform(list_filter(string_split(t, '{{'), lambda x: regexp_matches(x, '^-?\s*ref\s*\([^)]*\)[^{}]*\}\}')), lambda x: string_split(string_split(x, '(')[2], ')')[1])"


@query(
    "dbt_refs",
    f"""SELECT t, list_filter(list_transform(calls, lambda c: list_transform(list_filter(string_split(c, ','), lambda a: NOT contains(a, '=') AND regexp_matches(a, '[''"]')), lambda a: trim(trim(a), {_QUOTES}))[-1]), lambda x: x IS NOT NULL) AS refs
    FROM (SELECT t, {_DBT_CALLS} AS calls FROM ({_DBT_TEXTS}))""",
)
def dbt_refs(spark, sf):
    return _dbt_texts(spark, sf).select("t", extractors.dbt_refs(F.col("t")).alias("refs"))


def _dbt_texts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.col("html").alias("t")).union(p.select("html", F.explode(F.array(*map(F.lit, _DBT_OWN))).alias("x")).select(F.concat("html", "x")))


_PY = "'# ' || lang || chr(10) || 'def fn_' || doc_id || '(a: int) -> str:' || chr(10) || '    \"\"\"About ' || source || '.\"\"\"' || chr(10) || '    return \"' || source || '\"' || chr(10) || chr(10) || chr(10) || 'class C_' || doc_id || ':' || chr(10) || '    def m(self):' || chr(10) || '        pass' || chr(10)"
_RS = "'/// About ' || source || '.' || chr(10) || 'pub fn fn_' || doc_id || '(a: u32) -> u32 {' || chr(10) || '    a' || chr(10) || '}' || chr(10) || chr(10) || 'struct S_' || doc_id || ' {' || chr(10) || '    x: i32,' || chr(10) || '}' || chr(10)"


def _definition_sql(ext: str, start: int, end: int, kind: str, name: str, signature: str, docstring: str, context: str, content: str) -> str:
    return f"SELECT 'd/' || doc_id || '.{ext}' AS path, {start} AS start_line, {end} AS end_line, '{kind}' AS kind, {name} AS name, {signature} AS signature, {docstring} AS docstring, ['File: d/' || doc_id || '.{ext}', {context}] AS context, {content} AS content FROM documents"


_DEFINITIONS = [
    ("py", 1, 4, "Function", "'fn_' || doc_id", "'def fn_' || doc_id || '(a: int) -> str'", "'\"\"\"About ' || source || '.\"\"\"'", "'Function: fn_' || doc_id", "'def fn_' || doc_id || '(a: int) -> str:' || chr(10) || '    \"\"\"About ' || source || '.\"\"\"' || chr(10) || '    return \"' || source || '\"'"),
    ("py", 6, 9, "Class", "'C_' || doc_id", "'class C_' || doc_id", "NULL", "'Class: C_' || doc_id", "'class C_' || doc_id || ':' || chr(10) || '    def m(self):' || chr(10) || '        pass'"),
    ("py", 7, 9, "Method", "'m'", "'def m(self)'", "NULL", "'Class: C_' || doc_id, 'Method: m'", "'    def m(self):' || chr(10) || '        pass'"),
    ("rs", 1, 4, "Function", "'fn_' || doc_id", "'fn fn_' || doc_id || '(a: u32) -> u32'", "'/// About ' || source || '.'", "'Function: fn_' || doc_id", "'pub fn fn_' || doc_id || '(a: u32) -> u32 {' || chr(10) || '    a' || chr(10) || '}'"),
    ("rs", 5, 8, "Struct", "'S_' || doc_id", "'struct S_' || doc_id", "NULL", "'Struct: S_' || doc_id", "'struct S_' || doc_id || ' {' || chr(10) || '    x: i32,' || chr(10) || '}'"),
]


@query("code_definitions", " UNION ALL ".join(_definition_sql(*d) for d in _DEFINITIONS))
def code_definitions(spark, sf):
    """The definitions of two sources made from each document's row."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    files = [d.select(F.expr(f"'d/' || doc_id || '.{ext}'").alias("path"), F.lit(language).alias("language"), F.expr(text.replace("chr(10)", "'\\n'")).alias("content")) for ext, language, text in (("py", "Python", _PY), ("rs", "Rust", _RS))]
    return extractors.definitions(files[0].unionByName(files[1]))


@query("is_indexable", f"SELECT path, language <> 'Unknown' AS indexable FROM ({_SQL['language_map']})")
def is_indexable(spark, sf):
    return _paths(spark, sf).select("path", L.is_indexable(L.language(F.col("path"))).alias("indexable"))


@query("file_chunks", "SELECT doc_id AS chunk_id, source AS path, n_chars AS start_line, 1.0::DOUBLE AS score FROM documents WHERE source = 'src1'")
def file_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("./"), "source").alias("path"), F.col("n_chars").alias("start_line"))
    return ranking.file_chunks(d, "./src1").withColumn("path", ranking.normal_path("path"))


@query("ids_by_path", "SELECT 'd/' || doc_id // 10 AS path, list(doc_id ORDER BY doc_id) AS chunk_ids, count(*)::INT AS chunk_count FROM documents GROUP BY path")
def ids_by_path(spark, sf):
    """Ten documents as the chunks of a file: a list holds one file's ids."""
    return changes.ids_by_path(table(spark, sf, "documents").select(F.expr("'d/' || doc_id div 10").alias("path"), F.col("doc_id").alias("chunk_id")))


# ---- changes

_OLD = "SELECT 'd/' || doc_id AS path, sha256(text) AS hash, doc_id AS mtime, n_chars AS size FROM documents WHERE lang <> 'es'"
_NEW = "SELECT 'd/' || doc_id AS path, CASE WHEN lang = 'fr' THEN sha256(text || '!') ELSE sha256(text) END AS hash, CASE WHEN lang IN ('fr', 'de') THEN doc_id + 1 ELSE doc_id END AS mtime, n_chars AS size FROM documents WHERE source <> 'src3'"


def _snapshots(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("d/"), "doc_id").alias("path")
    old = d.where("lang <> 'es'").select(path, F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    fr = F.col("lang") == "fr"
    new = d.where("source <> 'src3'").select(path, F.sha2(F.when(fr, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"), F.when(F.col("lang").isin("fr", "de"), F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"), F.col("n_chars").alias("size"))
    return old, new


@query("change_detect", f"SELECT path, CASE WHEN o.mtime IS NULL THEN 'new' WHEN n.mtime IS NULL THEN 'deleted' WHEN (o.mtime = n.mtime AND o.size = n.size) OR o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status, o.hash AS old_hash, n.hash AS new_hash FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n USING (path)")
def change_detect(spark, sf):
    return changes.change_detect(*_snapshots(spark, sf))


@query("apply_deletes", f"SELECT path, hash FROM ({_OLD}) WHERE path NOT IN (SELECT path FROM ({_NEW}) WHERE size < 1000)")
def apply_deletes(spark, sf):
    old, new = _snapshots(spark, sf)
    return changes.without(old, new.where("size < 1000"), "path").select("path", "hash")


@query("cache_split", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT 'hit' AS part, count(*) AS n FROM n WHERE hash IN (SELECT hash FROM o) UNION ALL SELECT 'miss', count(DISTINCT hash) FROM n WHERE hash NOT IN (SELECT hash FROM o)")
def cache_split(spark, sf):
    old, new = _snapshots(spark, sf)
    cache = old.select("hash").distinct().withColumn("embedding", F.array(F.lit(0.0)))
    hits, misses = changes.cache_split(new, cache)
    return hits.agg(F.lit("hit").alias("part"), F.count("*").alias("n")).union(misses.agg(F.lit("miss"), F.count("*")))


@query("event_dedupe", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def event_dedupe(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return changes.event_dedupe(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("event_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def event_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return changes.event_dedupe(e, "user_id", ["ts", "event_id"], last=True).select("user_id", "event_id", "event_type")


# ---- statistics

@query("stats_counts", "SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_files FROM documents")
def stats_counts(spark, sf):
    return stats.store_stats(table(spark, sf, "documents"), "source")


@query(
    "combined_stats",
    "SELECT sum(c)::BIGINT AS total_chunks, sum(f)::BIGINT AS total_files, bool_or(c > 0) AS indexed, coalesce(sum(c) FILTER (db = 'local'), 0)::BIGINT AS local_chunks, coalesce(sum(c) FILTER (db = 'global'), 0)::BIGINT AS global_chunks, coalesce(sum(f) FILTER (db = 'local'), 0)::BIGINT AS local_files, coalesce(sum(f) FILTER (db = 'global'), 0)::BIGINT AS global_files FROM (SELECT CASE WHEN source = 'src0' THEN 'local' ELSE 'global' END AS db, count(*) AS c, count(DISTINCT source || lang) AS f FROM documents GROUP BY 1)",
)
def combined_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("source") == "src0", "local").otherwise("global").alias("db"), F.concat("source", "lang").alias("path"))
    return stats.combined_stats(d)


@query("lang_histogram", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def lang_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "documents"), "lang", 10)


@query("length_stats", "SELECT min(strlen(text)) AS min_bytes, max(strlen(text)) AS max_bytes, sum(strlen(text))::BIGINT AS sum_bytes, round(avg(strlen(text)), 6) AS avg_bytes FROM documents")
def length_stats(spark, sf):
    return stats.length_stats(table(spark, sf, "documents"), "text")


_EVAL = f"SELECT q.label::VARCHAR AS expected, n.label::VARCHAR AS found, cosine AS score, q.label = 0 AS is_negative FROM (SELECT * FROM ({_BATCH}) WHERE query_id <> id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1) JOIN embeddings q ON q.vec_id = query_id JOIN embeddings n ON n.vec_id = id"


@query("retrieval_eval", f"SELECT round(avg(contains(found, expected)::INT) FILTER (NOT is_negative), 6) AS accuracy, round(avg(score) FILTER (NOT is_negative), 6) AS avg_score, round(avg(score) FILTER (is_negative), 6) AS false_positive_score FROM ({_EVAL})")
def retrieval_eval(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = vector_search.batch_top_k(v, q, 2, "vec_id").where("query_id <> id")
    best = ranking.dedup_best(best, ["query_id"], "cosine", "id")
    name = lambda key, out: v.select(F.col("vec_id").alias(key), F.col("label").cast("string").alias(out))
    rows = best.join(name("query_id", "expected"), "query_id").join(name("id", "found"), "id")
    return stats.retrieval_eval(rows.select("expected", "found", F.col("cosine").alias("score"), (F.col("expected") == "0").alias("is_negative")))
