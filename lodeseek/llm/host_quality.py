"""Quality rules judged by host: DataFrame functions only.

Each document gets its counts and the rules it fails.  Failures are summed by host and rule (partial
sums before the shuffle, so a host with a third of the rows costs no more than another).  For each
rule an empirical beta prior is fitted to the hosts by moments and every host's rate is shrunk by it;
where the hosts differ no more than sampling gives, the rate of the whole is every host's.  A host is
rejected where the shrunk rate of any rule reaches ``limit``; verdicts go back to its documents.

The tables have no address of a document: the host is their ``source``.

Defined results: null and empty texts have no words and fail; a null source is one host of its own;
repeated rows count each; a text of any length is counted whole; an empty table gives an empty result;
further columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Percent of a document's characters, and of its lines, from which a rule counts as failed.
MOST_SYMBOLS, MOST_DUPLICATE_LINES = 25, 60
#: Shrunk failure rate of a rule from which a host is rejected.
HOST_LIMIT = 0.5
#: The least weight of a prior, in documents.
LEAST_STRENGTH = 2.0
#: The rules: a document fails where the SQL holds.  The first two fail it by themselves.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": f"n_repeat_words * 100 > n_words * {MOST_REPEATED}",
    "symbols": f"n_symbols * 100 > word_chars * {MOST_SYMBOLS}",
    "duplicates": f"n_dup_lines * 100 > n_lines * {MOST_DUPLICATE_LINES}",
}
BLANKS = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, source and the counts of every document."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    d = d.select(
        "doc_id",
        "source",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        words.alias("words"),
        lines.alias("lines"),
    )
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    windows = F.when(F.col("n_words") >= WINDOW, F.expr(f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")).otherwise(F.expr("array()").cast("array<bigint>"))
    d = d.withColumn("windows", windows).drop("words", "lines")
    # only texts that repeat a window look where: windows sorted by hash stand beside their equals
    d = d.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) END")).drop("windows")
    d = d.withColumn("places", F.expr("array_sort(transform(filter(transform(sorted, (s, k) -> named_struct('i', s.i, 'twice', coalesce(s.h = get(sorted, k - 1).h, false) OR coalesce(s.h = get(sorted, k + 1).h, false))), s -> s.twice), s -> s.i))")).drop("sorted")
    repeated = F.expr(f"coalesce(aggregate(transform(places, (p, k) -> least({WINDOW}, coalesce(get(places, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x), 0L)")
    d = d.withColumn("n_repeat_words", repeated).drop("places")
    for name, failed in RULES.items():
        d = d.withColumn(name, F.expr(failed))
    return d.withColumn("base_failed", F.col("few_words") | F.col("repeats"))


def priors(hosts: DataFrame) -> dict[str, tuple[float, float | None]]:
    """Per rule the mean of its beta prior and the prior's weight in documents; None: the hosts' rates
    vary no more than those of samples from the whole."""
    sums = [F.sum("host_docs").alias("n"), F.count("*").alias("k")]
    for rule in RULES:
        sums += [F.sum(rule).alias(f"{rule}_f"), F.sum(F.col(rule) / F.col("host_docs") * F.col(rule)).alias(f"{rule}_ff")]
    whole, found = hosts.agg(*sums).first(), {}
    for rule in RULES:
        if not whole["n"]:
            found[rule] = (0.0, None)
            continue
        mean = whole[f"{rule}_f"] / whole["n"]
        within = mean * (1 - mean)
        # variance between the hosts' rates, less what sampling alone gives
        between = whole[f"{rule}_ff"] / whole["n"] - mean * mean - within * (whole["k"] / whole["n"])
        found[rule] = (mean, max(within / between - 1, LEAST_STRENGTH) if between > 0 else None)
    return found


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host its documents, each rule's failures and shrunk rate, and the highest rate."""
    hosts = judged.groupBy("source").agg(F.count("*").alias("host_docs"), *(F.sum(F.col(rule).cast("long")).alias(rule) for rule in RULES))
    rates = {
        rule: F.lit(mean) if strength is None else (F.col(rule) + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
        for rule, (mean, strength) in priors(hosts).items()
    }
    out = hosts.select("source", "host_docs", *(F.col(rule).alias(f"{rule}_failures") for rule in RULES), *(rate.alias(f"{rule}_rate") for rule, rate in rates.items()))
    return out.withColumn("host_rate", F.greatest(*(f"{rule}_rate" for rule in RULES)))


def judge(documents: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    judged = written(counts(documents), "counts")
    hosts = host_rates(judged).withColumnRenamed("source", "host")
    # null sources meet too; Spark picks a broadcast only below its size threshold, else splits skew
    out = judged.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") < limit)
    return out.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RULES, *(F.round(f"{rule}_rate", 6).alias(f"{rule}_rate") for rule in RULES), F.round("host_rate", 6).alias("host_rate"), kept.alias("kept"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", *RULES)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}
), g2 AS (
  SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM g
), g3 AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g2
), r AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM
    (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g3 WHERE n > 1) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), j AS (
  SELECT *, {", ".join(f"{failed} AS {rule}" for rule, failed in RULES.items())} FROM c
), h AS (
  SELECT source AS host, count(*)::DOUBLE AS docs, {", ".join(f"sum({rule}::INT)::DOUBLE AS {rule}_f" for rule in RULES)} FROM j GROUP BY source
), t AS (
  SELECT sum(docs) AS n, count(*)::DOUBLE AS k, {", ".join(f"sum({rule}_f) / sum(docs) AS {rule}_mean, sum({rule}_f / docs * {rule}_f) AS {rule}_ff" for rule in RULES)} FROM h
), v AS (
  SELECT *, {", ".join(f"{rule}_mean * (1 - {rule}_mean) AS {rule}_within, {rule}_ff / n - {rule}_mean * {rule}_mean - {rule}_mean * (1 - {rule}_mean) * (k / n) AS {rule}_between" for rule in RULES)} FROM t
), p AS (
  SELECT *, {", ".join(f"CASE WHEN {rule}_between > 0 THEN greatest({rule}_within / {rule}_between - 1, {LEAST_STRENGTH}) END AS {rule}_weight" for rule in RULES)} FROM v
), x AS (
  SELECT host, {", ".join(f"coalesce(({rule}_f + {rule}_mean * {rule}_weight) / (docs + {rule}_weight), {rule}_mean) AS {rule}_rate" for rule in RULES)} FROM h, p
), y AS (
  SELECT *, greatest({", ".join(f"{rule}_rate" for rule in RULES)}) AS rate FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
       {", ".join(f"round({rule}_rate, 6) AS {rule}_rate" for rule in RULES)}, round(rate, 6) AS host_rate,
       NOT (few_words OR repeats) AND rate < {HOST_LIMIT} AS kept
FROM j JOIN y ON source IS NOT DISTINCT FROM host
"""
