"""Full text: postings, BM25 and phrases over several fields.

Postings are one row per (field, term, id) with frequency and positions; written sorted by term they
are pruned by row-group statistics.  A query keeps only its own terms' postings before anything is
shuffled.  Statistics are per field, over all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def token_rows(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, position, term) of every token; fields: name to column."""
    each = [F.struct(F.lit(name).alias("field"), T.tokens(F.col(column)).alias("tokens")) for name, column in fields.items()]
    d = df.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("f"))
    return d.select("id", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("position", "term"))


def postings(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(field, term, id, tf, positions)."""
    rows = token_rows(df, id_col, fields)
    return rows.groupBy("field", "term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def all_postings(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """The rows of ``postings`` where ids are unique, with the field's length ``dl``, made within each
    document and without a shuffle: its tokens in order of term stand in runs.  For writing; a query's
    few terms are cheaper to keep from single tokens."""
    each = [F.struct(F.lit(name).alias("field"), T.tokens(F.col(column)).alias("tokens")) for name, column in fields.items()]
    d = df.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("f")).select("id", "f.field", "f.tokens")
    d = d.withColumn("s", F.expr("sort_array(transform(tokens, (t, i) -> named_struct('t', t, 'i', i)))")).drop("tokens")
    d = d.withColumn("starts", F.expr("filter(transform(s, (x, k) -> CASE WHEN k = 0 OR s[k - 1].t <> x.t THEN k END), k -> k IS NOT NULL)"))
    run = "sequence(k, coalesce(get(starts, j + 1), size(s)) - 1)"
    terms = f"transform(starts, (k, j) -> named_struct('term', s[k].t, 'positions', transform({run}, p -> s[p].i)))"
    d = d.select("id", "field", F.size("s").cast("long").alias("dl"), F.explode(F.expr(terms)).alias("p"))
    return d.select("field", "p.term", "id", F.size("p.positions").cast("long").alias("tf"), "p.positions", "dl")


def counted_postings(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """The rows of ``all_postings`` without positions: where only frequencies are kept."""
    each = [F.struct(F.lit(name).alias("field"), F.sort_array(T.tokens(F.col(column))).alias("s")) for name, column in fields.items()]
    d = df.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("f")).select("id", "f.field", "f.s")
    d = d.withColumn("starts", F.expr("filter(transform(s, (x, k) -> CASE WHEN k = 0 OR s[k - 1] <> x THEN k END), k -> k IS NOT NULL)"))
    terms = "transform(starts, (k, j) -> named_struct('term', s[k], 'tf', CAST(coalesce(get(starts, j + 1), size(s)) - k AS LONG)))"
    return d.select("id", "field", F.size("s").cast("long").alias("dl"), F.explode(F.expr(terms)).alias("p")).select("field", "p.term", "id", "p.tf", "dl")


def lengths(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, dl): tokens of each field; no shuffle."""
    each = [F.struct(F.lit(name).alias("field"), F.size(T.tokens(F.col(column))).cast("long").alias("dl")) for name, column in fields.items()]
    return df.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("f")).select("id", "f.field", "f.dl")


def corpus_stats(lens: DataFrame) -> DataFrame:
    """(field, n, avgdl)."""
    return lens.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf, dl, avgdl):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class Clause:
    """One part of a query: its terms in order (several form a phrase), field, and what is asked."""

    terms: tuple[str, ...]
    field: str | None = None
    occur: str = "must"  # must, should or not


_PART = re.compile(r'\s*([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse(query: str, fields: set[str], default: str = "must") -> list[Clause]:
    """Words, "phrases", field:term, + and -, AND, OR and NOT; what does not parse is read again with
    special characters as spaces.  A word of several tokens is a phrase."""
    plain = lambda q: [c for w in q.split() if (c := _clause(w, None, default))]
    fallback = lambda: plain(re.sub(T.SPECIAL, " ", query))
    if query.count('"') % 2 or re.search(r"[()\[\]{}^~*?\\/]", query):
        return fallback()
    out: list[Clause] = []
    at, occur, joined = 0, None, False
    while at < len(query.rstrip()):
        m = _PART.match(query, at)
        if not m:
            return fallback()
        at, sign, field, phrase, word = m.end(), *m.groups()
        if phrase is None and not sign and field is None and word in ("AND", "OR", "NOT"):
            if word == "OR" and out:
                out[-1] = Clause(out[-1].terms, out[-1].field, "should" if out[-1].occur == "must" else out[-1].occur)
            occur, joined = {"AND": "must", "OR": "should", "NOT": "not"}[word], True
            continue
        if field is not None and field not in fields or phrase is None and ":" in word:
            return fallback()
        clause = _clause(phrase if phrase is not None else word, field, {"+": "must", "-": "not"}.get(sign, occur or default))
        if clause:
            out.append(clause)
        occur, joined = None, False
    return fallback() if joined else out


def _clause(text: str, field: str | None, occur: str) -> Clause | None:
    terms = tuple(t for t in re.findall(r"[^\W_]+", text.lower()) if len(t.encode()) < T.TOKEN_BYTES)
    return Clause(terms, field, occur) if terms else None


def matches(post: DataFrame, lens: DataFrame | None, clauses: list[Clause], totals: DataFrame | None = None) -> DataFrame:
    """(id, score): documents that satisfy all clauses, with the sum of what matched.

    A phrase scores as one term whose frequency is its number of occurrences.  Lengths come from the
    postings where these have ``dl``, else from ``lens``; so do the totals, unless they are given.
    """
    spark = post.sparkSession
    own = ["dl"] if "dl" in post.columns else []
    rows = [(c, t, k) for c, clause in enumerate(clauses) for k, t in enumerate(clause.terms)]
    schema = "clause int, term string, nth int"
    asked = F.broadcast(spark.createDataFrame(rows, schema))  # a query's terms
    what = F.broadcast(spark.createDataFrame([(c, len(x.terms), x.field, x.occur) for c, x in enumerate(clauses)], "clause int, n_terms int, only string, occur string"))
    hits = post.where(F.col("term").isin([r[1] for r in rows])).join(asked, "term").join(what, "clause").where("only IS NULL OR only = field")
    # starts of a phrase: positions less the place of the term, that all its terms have
    begun = hits.select("clause", "occur", "n_terms", "field", "id", *own, "nth", F.explode(F.transform("positions", lambda p: p - F.col("nth"))).alias("start"))
    single = hits.where("n_terms = 1").select("clause", "occur", "field", "id", *own, F.col("tf").cast("long").alias("tf"))
    phrase = begun.where("n_terms > 1").groupBy("clause", "occur", "n_terms", "field", "id", *own, "start").agg(F.count_distinct("nth").alias("have")).where("have = n_terms")
    found = single.unionByName(phrase.groupBy("clause", "occur", "field", "id", *own).agg(F.count("*").alias("tf")))
    df = found.groupBy("clause", "field").agg(F.count("*").alias("df"))
    weighed = found.join(F.broadcast(df), ["clause", "field"])  # a row a clause and field
    weighed = weighed if own else weighed.join(lens, ["id", "field"])
    weighed = weighed.join(F.broadcast(corpus_stats(lens) if totals is None else totals), "field")  # a row a field
    weighed = weighed.withColumn("s", idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl")))
    must = sum(c.occur == "must" for c in clauses)
    per = weighed.groupBy("id").agg(
        F.sum(F.when(F.col("occur") != "not", F.col("s")).otherwise(0.0)).alias("score"),
        F.count_distinct(F.when(F.col("occur") == "must", F.col("clause"))).alias("must"),
        F.max((F.col("occur") == "not").cast("int")).alias("banned"),
    )
    return per.where((F.col("must") == must) & (F.col("banned") == 0) & (F.col("score") > 0)).select("id", "score")


def search(df: DataFrame, id_col: str, fields: dict[str, str], query: str, limit: int | None = None, mode: str = "and") -> DataFrame:
    """BM25 hits of a query: every word must match in some field (mode "or": any)."""
    clauses = parse(query, set(fields), "must" if mode == "and" else "should")
    post, lens = postings(df, id_col, fields), lengths(df, id_col, fields)
    if not clauses:
        return post.select("id", F.lit(0.0).alias("score")).limit(0)
    found = matches(post, lens, clauses)
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found
