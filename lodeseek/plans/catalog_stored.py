"""Queries of stored indexes, files, events and caches, each over whole tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, block_max, changes, events, fts, ranking, stats
from ..sources import files as S
from ..sources import ignore
from ..sources import languages as L
from ..storage import fresh_path, written
from . import catalog as C
from .catalog import query, table

# ---- vectors in cells

_CELLS = f"greatest(1, least({ann.MOST_CELLS}, floor(sqrt(n))))::INT"


_NEAR_CELL = "list_cosine_similarity(e.embedding::DOUBLE[], m.v::DOUBLE[]) DESC, m.cell"


@query(
    "ann_search",
    f"""WITH e AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT {_CELLS} AS cells FROM (SELECT count(*) AS n FROM e)),
    m AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cell, v FROM (SELECT min(h) AS h, embedding AS v FROM
      (SELECT h, embedding FROM (SELECT sha256(vec_id::VARCHAR) AS h, embedding, row_number() OVER (ORDER BY sha256(vec_id::VARCHAR), embedding) AS k FROM e), c WHERE k <= cells) GROUP BY embedding)),
    a AS MATERIALIZED (SELECT vec_id, cell, embedding, row_number() OVER (PARTITION BY vec_id ORDER BY {_NEAR_CELL}) AS nth FROM e, m),
    s AS (SELECT vec_id FROM e ORDER BY sha256('q' || vec_id), embedding LIMIT {ann.ASKED}),
    t AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {C._COS} DESC, e.vec_id) AS rank FROM e, (SELECT * FROM e WHERE vec_id IN (FROM s)) q),
    n AS (SELECT b.nth, row_number() OVER (ORDER BY b.nth) AS k, count(*) OVER () AS total FROM t JOIN a ON a.vec_id = t.vec_id AND a.nth = 1 JOIN a b ON b.vec_id = t.query_id AND b.cell = a.cell WHERE rank <= {ann.NEIGHBOURS}),
    p AS (SELECT nth AS probes FROM n WHERE k = ceil({ann.RECALL} * total)::INT),
    q AS (SELECT vec_id AS query_id, cell FROM a, p WHERE vec_id % 100 = 0 AND nth <= probes),
    r AS (SELECT q.query_id, e.vec_id AS id, {C._COS.replace("q.embedding", "o.embedding")} AS cosine FROM q JOIN a e ON e.cell = q.cell AND e.nth = 1 JOIN e o ON o.vec_id = q.query_id)
    SELECT query_id, id, round(cosine, 6) AS cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM r) WHERE rank <= 10""",
)
def ann_search(spark, sf):
    """An index stored by cells, read for every vector whose id is divisible by 100."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    marks = ann.landmarks(v, "vec_id")
    at = fresh_path(spark, "cells")
    ann.write(ann.with_cells(v, marks), at, "vec_id")
    stored = spark.read.schema("vec_id long, embedding array<float>, cell int").parquet(at)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ann.batch_search(stored, marks, q, 10, ann.tuned_probes(v, marks, "vec_id"), "vec_id")
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


# ---- keywords in blocks

PRUNED = ["the", "of"]


@query("fts_topk_pruned", f"SELECT id, round(score, 6) AS score FROM ({C.bm25_sql('documents', 'doc_id', {'text': 'text'}, PRUNED)}) ORDER BY score DESC, id LIMIT 200")
def fts_topk_pruned(spark, sf):
    """The 200 best of two common words, from postings in blocks."""
    post = written(block_max.with_blocks(fts.counted_postings(table(spark, sf, "documents"), "doc_id", {"text": "text"})), "postings")
    # the texts are not taken apart again for their lengths: frequencies add up to them
    n, tokens = table(spark, sf, "documents").count(), post.agg(F.sum("tf")).first()[0] or 0
    totals = {"text": (n, tokens / max(n, 1))}
    blocks = written(block_max.block_table(post), "blocks")
    top, _ = block_max.top_k(post, blocks, totals, PRUNED, 200)
    return top.withColumn("score", F.round("score", 6))


@query("fts_block_bounds", f"""WITH t AS (SELECT doc_id AS id, {C._TOK.format(c="text")} AS toks FROM documents),
    p AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM t), f AS (SELECT id, any_value(dl) AS dl, term, count(*) AS tf FROM p GROUP BY id, term)
    SELECT 'text' AS field, term, id // {block_max.BLOCK} AS block, count(*) AS n, max(tf) AS max_tf, min(dl)::BIGINT AS min_dl FROM f GROUP BY term, block""")
def fts_block_bounds(spark, sf):
    """Of each term and block of ids what bounds its scores."""
    return block_max.block_table(block_max.with_blocks(fts.counted_postings(table(spark, sf, "documents"), "doc_id", {"text": "text"})))


#: What a second segment holds, and what is gone from both.
_SECOND, _GONE = "lang IN ('fr', 'es')", "source = 'src3'"


@query("segment_search", f"SELECT id, round(score, 6) AS score FROM ({C.bm25_sql(f'(SELECT * FROM documents WHERE NOT coalesce({_GONE}, false))', 'doc_id', {'text': 'text'}, C.KEYWORDS.split())})")
def segment_search(spark, sf):
    """Keywords over postings of two segments without the rows of a table of gone ids; what is gone is
    taken off the totals, which are not counted anew."""
    second, gone = (F.coalesce(F.expr(x), F.lit(False)) for x in (_SECOND, _GONE))
    docs = table(spark, sf, "documents").select("doc_id", "text", second.alias("second"), gone.alias("gone"))
    parts = [written(fts.counted_postings(docs.where(own), "doc_id", {"text": "text"}), "segment") for own in ("NOT second", "second")]
    lens = written(docs.select("doc_id", "second", "gone", F.size(C.T.tokens("text")).cast("long").alias("dl")), "lengths")
    per = lens.groupBy("second").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).drop("second")
    less = lens.where("gone").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("dl"))
    totals = per.union(less).agg(F.lit("text").alias("field"), F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
    live = parts[0].unionByName(parts[1]).join(lens.where("gone").select(F.col("doc_id").alias("id")), "id", "left_anti")
    found = fts.matches(live.withColumn("positions", F.array().cast("array<int>")), None, fts.parse(C.KEYWORDS, {"text"}), totals)
    return found.withColumn("score", F.round("score", 6))


@query("fts_fallback", f"SELECT id, round(score, 6) AS score FROM ({C._BM25})")
def fts_fallback(spark, sf):
    """A text that is no query is read with its special characters as blanks."""
    return fts.search(table(spark, sf, "documents"), "doc_id", {"text": "text"}, "license) [version").withColumn("score", F.round("score", 6))


# ---- files

#: Rules of the tree that the pages' addresses make: folder, level, line and pattern.
_ROOT_RULES = [("*.html", r"(?:.*/)?[^/]*\.html", False, False), ("!*5.html", r"(?:.*/)?[^/]*5\.html", True, False), ("blog.*", r"(?:.*/)?blog\.[^/]*", False, False), ("de/", r"(?:.*/)?de", False, True), ("# none", None, False, False), ("/m.*/en/*[0-4]", r"m\.[^/]*/en/[^/]*[0-4]", False, False)]
_HOST_RULES = [("!de/", r"(?:.*/)?de", True, True), ("fr", r"(?:.*/)?fr", False, False), ("!/fr/*", r"fr/[^/]*", True, False), ("en/**/[6-9]*", r"en/(?:[^/]+/)*[6-9][^/]*", False, False)]
_PATHS_SQL = r"SELECT DISTINCT regexp_replace(string_split(url, '://')[2], '[/?#]*$', '') AS relative FROM pages"


def _rules_sql() -> str:
    quoted = lambda rows: ", ".join(f"({k}, '{rx}', {back}, {only})" for k, (_, rx, back, only) in enumerate(rows) if rx)
    return f"""SELECT '' AS folder, 0 AS level, * FROM (VALUES {quoted(_ROOT_RULES)}) AS t(line, rx, back, only_dir)
      UNION ALL SELECT folder, 1, t.* FROM (SELECT DISTINCT string_split(relative, '/')[1] AS folder FROM paths WHERE length(relative) % 3 = 0), (VALUES {quoted(_HOST_RULES)}) AS t(line, rx, back, only_dir)"""


@query(
    "ignore_rules",
    f"""WITH paths AS (SELECT * FROM ({_PATHS_SQL}) WHERE relative <> ''), rules AS ({_rules_sql()}),
    s AS (SELECT relative, p, k, k < len(p) AS is_dir FROM (SELECT relative, string_split(relative, '/') AS p, unnest(range(1, len(string_split(relative, '/')) + 1)) AS k FROM paths)),
    a AS (SELECT relative, k, is_dir, array_to_string(p[1:f], '/') AS folder, array_to_string(p[f + 1:k], '/') AS tail FROM (SELECT *, unnest(range(0, k)) AS f FROM s)),
    v AS (SELECT relative, k, arg_max(NOT back, (level, line)) AS out FROM a JOIN rules USING (folder) WHERE (is_dir OR NOT only_dir) AND regexp_full_match(tail, rx) GROUP BY relative, k)
    SELECT relative, bool_or(coalesce(v.out, false)) AS ignored FROM paths LEFT JOIN v USING (relative) GROUP BY relative""",
)
def ignore_rules(spark, sf):
    """Addresses as paths, under rules at the root and in some hosts' folders."""
    paths = table(spark, sf, "pages").select(F.regexp_replace(F.split("url", "://")[1], "[/?#]*$", "").alias("relative")).where("relative <> ''").distinct()
    rules = spark.createDataFrame([("", 0, k, p) for k, (p, *_) in enumerate(_ROOT_RULES)], ignore.RULES)
    hosts = paths.where("length(relative) % 3 = 0").select(F.split("relative", "/")[0].alias("folder")).distinct()
    own = F.posexplode(F.array(*(F.lit(p) for p, *_ in _HOST_RULES)))
    rules = rules.unionByName(hosts.select("folder", F.lit(1).alias("level"), own.alias("line", "pattern")))
    out = ignore.ignored_paths(paths, rules).withColumn("ignored", F.lit(True))
    return paths.join(out, "relative", "left").select("relative", F.coalesce("ignored", F.lit(False)).alias("ignored"))


#: Contents made of the documents: as they are, with a zero byte, with control characters, cut within a character.
_RAW = [("plain", "encode({t})", "encode({t}, 'utf-8')"), ("zero", "encode({t} || chr(0))", "encode(concat({t}, '\\u0000'), 'utf-8')"), ("control", "encode(translate({t}, 'aeiou', chr(1) || chr(2) || chr(3) || chr(4) || chr(5)))", "encode(translate({t}, 'aeiou', '\\u0001\\u0002\\u0003\\u0004\\u0005'), 'utf-8')"), ("latin", "unhex(replace(hex(encode({t})), 'C3', 'E9'))", "unhex(replace(hex(encode({t}, 'utf-8')), 'C3', 'E9'))")]
_RAW_SQL = " UNION ALL ".join(f"SELECT '{k}/' || doc_id AS path, {sql.format(t='text')} AS content FROM documents" for k, sql, _ in _RAW)
_BYTES = f"regexp_extract_all(left(hex(content), {2 * L.SAMPLE}), '..')"
_BINARY = f"""SELECT path, content, len(b) > 0 AND (list_contains(b, '00') OR (odd / len(b) > 0.3 AND TRY(decode(unhex(array_to_string(b, '')))) IS NULL) OR odd / len(b) > 0.8) AS is_binary
    FROM (SELECT *, len(list_filter(b, lambda x: NOT (x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E'))) AS odd FROM (SELECT path, content, {_BYTES} AS b FROM ({_RAW_SQL})))"""


def _raw(spark, sf):
    d = table(spark, sf, "documents")
    parts = [d.select(F.concat(F.lit(f"{k}/"), "doc_id").alias("path"), F.expr(made.format(t="text")).alias("content")) for k, _, made in _RAW]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("binary_content", f"SELECT path, is_binary FROM ({_BINARY})")
def binary_content(spark, sf):
    return _raw(spark, sf).select("path", L.binary_by_content(F.col("content")).alias("is_binary"))


@query("read_report", f"SELECT CASE WHEN is_binary THEN 'binary' WHEN TRY(decode(content)) IS NULL THEN 'not UTF-8' ELSE 'text' END AS outcome, count(*) AS files, sum(octet_length(content))::BIGINT AS bytes FROM ({_BINARY}) GROUP BY outcome")
def read_report(spark, sf):
    """Files read and left out, by reason."""
    return S.read_report(_raw(spark, sf))


# ---- chunks


def files_of_documents(spark, sf):
    """Every document as a Markdown file of an index: path, language, content, content_hash, mtime, size."""
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".md"))
    return d.select(path.alias("path"), F.lit("Markdown").alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.lit(0).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("size"))


@query(
    "chunk_sizes",
    f"SELECT doc_id, len({C._LINES.format(c='text')})::INT AS line_count, strlen(text)::BIGINT AS size_bytes, nullif(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS is_duplicate_of FROM documents",
)
def chunk_sizes(spark, sf):
    d = table(spark, sf, "documents")
    d = d.select("doc_id", F.size(C.T.lines("text")).alias("line_count"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("hash"))
    return ranking.with_original(d, "hash", "doc_id", "is_duplicate_of").drop("hash")


@query("hydrate", f"SELECT id, score, source AS path, coalesce(lang, 'unknown') AS kind FROM (SELECT id * 2 AS id, score FROM ({C._HYBRID})) LEFT JOIN documents ON doc_id = id")
def hydrate(spark, sf):
    """What is shown of the best rows; of those that have gone (here ids beyond the table) the id alone."""
    top = C._shown(ranking.weighted_rrf(*C.both_lists(spark, sf), 0.5)).select("id", "score").orderBy(F.desc("score"), "id").limit(25)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("kind"))
    return ranking.hydrated(top.withColumn("id", F.col("id") * 2), docs, {"kind": "unknown"})


@query("kind_histogram", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def kind_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "conversations"), "role")


# ---- changes

@query("upsert", f"SELECT path, hash, mtime, size FROM ({C._NEW}) UNION ALL SELECT path, hash, mtime, size FROM ({C._OLD}) WHERE path NOT IN (SELECT path FROM ({C._NEW}))")
def upsert(spark, sf):
    old, new = C._snapshots(spark, sf)
    return changes.upsert(old, new, "path").select("path", "hash", "mtime", "size")


GAP = "2 hours"


@query(
    "event_debounce",
    f"""SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM
    (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM
      (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {GAP}, true) AS fresh FROM events)) GROUP BY user_id, burst""",
)
def event_debounce(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return events.bursts(e, ["user_id"], "ts", "event_id", GAP).select("user_id", "event_id", "event_type", "n", "first_ts", "last_ts")


@query(
    "cache_eviction",
    """WITH c AS (SELECT sha256(text) AS key, max(doc_id % 97) AS used, max(strlen(text))::BIGINT AS bytes FROM documents GROUP BY key),
    r AS (SELECT *, sum(bytes) OVER (ORDER BY used DESC, key ROWS UNBOUNDED PRECEDING) AS upto FROM c)
    SELECT key, used, bytes FROM r WHERE upto <= 1000000""",
)
def cache_eviction(spark, sf):
    """Texts as a cache of a million bytes: those used last stay."""
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.max(F.expr("doc_id % 97")).alias("used"), F.max(F.octet_length("text").cast("long")).alias("bytes"))
    return changes.within_budget(d, "used", "bytes", "key", 1_000_000)
