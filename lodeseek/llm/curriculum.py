"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight that changes over training time 0 to 1, linear between equally spaced knots;
its integral is the source's weight in the whole mix.  Targets share the words of all documents by these
integrals; a source stops at ``limit`` times its own words and what is over is shared again.  A source is
read in an order that a hash of the id gives, again and again until its target is reached; the document
at which it ends is taken in part.  The word with which a reading of a document begins has a demand: the
words of its source that come before it.  The source's integrated schedule is inverted there, which gives
the training time of that reading, and the integrated schedules of all sources give its position among
all words of the mix.  ``training_order`` range-sorts the readings by position.

Sources may be many and one may hold most rows: documents are range-sorted by source and hash, ranges add
up what they hold and only the sums of ranges and sources are joined back, so no task sees a whole source.

Defined results: a null text has no words; null is a source of its own, behind all others; repeated rows
are documents of their own; a null id is hashed as an empty text; documents without words are taken 0
times and have no readings; a table without words has targets of 0; an empty table gives an empty result;
a text of any length is one document; further columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import with_ids
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights over training time of the first, second, third source and so on, repeating; their means are
#: 1, 2 and 3.  Light sources fade, heavy ones grow towards the end.
SCHEDULES = ((1.5, 1.0, 0.5), (2.0, 2.0, 2.0), (1.5, 3.0, 4.5))
LIMIT = 3


def area(knots) -> float:
    """The integral of a schedule over time 0 to 1."""
    return sum(a + b for a, b in zip(knots, knots[1:])) / 2 / (len(knots) - 1)


def source_targets(sizes: DataFrame, schedules=SCHEDULES, limit: int = LIMIT) -> DataFrame:
    """sizes: source, source_size, one row each.  Adds rank, weight and target.

    A round shares what is left among the sources below their limit by weight and stops those above
    it; the driver sees two sums a round, however many sources there are.
    """
    last = sizes.withColumn("_last", F.col("source").isNull())
    ranked = with_ids(last, ["_last", "source"], 0, "rank").drop("_last")
    weights = F.array(*(F.lit(float(area(s))) for s in schedules))
    ranked = written(ranked.withColumn("weight", weights[F.pmod("rank", F.lit(len(schedules))).cast("int")]), "sources")
    total = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap, level = F.col("source_size") * limit, None
    while True:
        # a source is full where an even share at the level so far passes its limit; levels only rise
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        row = ranked.agg(F.sum(F.when(full, cap).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        now = (total - int(row.full or 0)) / row.weight if row.weight else None
        if now is None or level is not None and now <= level:
            break
        level, rest, over = now, total - int(row.full or 0), row.weight
    if level is None:
        return ranked.withColumn("target", F.lit(0.0))
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(over))
    return ranked.withColumn("target", F.least(share, cap.cast("double")))


def _integral(knots: list[float]) -> list[tuple[float, float, float]]:
    """(share before, weight at the start, rise) of each segment, scaled to an integral of 1."""
    whole, n, before, out = area(knots), len(knots) - 1, 0.0, []
    for a, b in zip(knots, knots[1:]):
        out.append((before, a / whole, (b - a) / whole * n))
        before += (a + b) / 2 / n / whole
    return out


def _inverse(segments, n: int, share):
    """The time at which a schedule has integrated to ``share``."""
    time = None
    for j, (before, start, rise) in reversed(list(enumerate(segments))):
        rest = F.greatest(share - before, F.lit(0.0))
        root = start + F.sqrt(F.greatest(F.lit(start * start) + rest * (2 * rise), F.lit(0.0)))
        here = F.lit(j / n) + F.when(root > 0, F.least(rest * 2 / root, F.lit(1 / n))).otherwise(F.lit(0.0))
        time = here if time is None else F.when(share < segments[j + 1][0], here).otherwise(time)
    return time


def _before(segments, n: int, time):
    """What a schedule has integrated to at a time, of 1 in all."""
    share = None
    for j, (before, start, rise) in reversed(list(enumerate(segments))):
        x = time - F.lit(j / n)
        here = F.lit(before) + x * start + x * x * (rise / 2)
        share = here if share is None else F.when(time < (j + 1) / n, here).otherwise(share)
    return share


def _running(batches):
    """Adds the words of the same source earlier in the partition, whose rows are sorted by source."""
    last, carried = object(), 0
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column(2).to_numpy(zero_copy_only=False)
        codes = b.column(1).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        before = np.cumsum(size) - size
        begins = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        before = before - np.repeat(before[begins], np.diff(np.append(begins, len(codes))))
        if b.column(1)[0].as_py() == last:
            before[: begins[1] if len(begins) > 1 else len(codes)] += carried
        last, carried = b.column(1)[-1].as_py(), int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(before, pa.int64())], names=["doc_id", "source", "size", "range", "before"])


def mix(documents: DataFrame, schedules=SCHEDULES, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and readings of every document; a reading is a
    struct of pass, words, time (0 to 1) and position (the words of the mix before it)."""
    n = len(schedules[0]) - 1
    if n < 1 or any(len(s) != n + 1 or min(s) < 0 or area(s) <= 0 for s in schedules):
        raise ValueError("schedules need two knots at least, alike in number, none below 0, one above")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    docs = docs.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # the row number parts even rows that are equal, any of which may stand for another
    order = ["source", "key", "size", "row"]
    docs = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    docs = docs.select("doc_id", "source", "size", F.spark_partition_id().alias("range"))
    docs = written(docs.mapInArrow(_running, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size long, range int, before long"), "ranges")
    sums = written(docs.groupBy("source", "range").agg(F.sum("size").alias("words")), "range-sums")
    sources = written(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, limit), "targets")
    # a source has no more ranges than the sort has partitions
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("begin", F.coalesce(F.sum("words").over(w), F.lit(0))).select(F.col("source").alias("of"), F.col("range").alias("at"), "begin")
    begins = begins.join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    d = docs.join(begins, (F.col("range") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    kind = F.pmod("rank", F.lit(len(schedules)))
    segments = [_integral(s) for s in schedules]
    whole = {r.k: r.target for r in sources.groupBy(kind.alias("k")).agg(F.sum("target").alias("target")).collect()}  # a row a schedule

    def by_kind(make):
        found = make(segments[-1])
        for k in reversed(range(len(segments) - 1)):
            found = F.when(kind == k, make(segments[k])).otherwise(found)
        return found

    first = F.col("before") + F.col("begin")

    def reading(p):
        demand = p * F.col("source_size") + first
        words = F.least(F.col("size"), F.floor("target") - demand)
        return F.struct(p.cast("int").alias("pass"), words.cast("long").alias("words"), (demand / F.col("target")).alias("share"))

    def placed(r):
        time = by_kind(lambda s: _inverse(s, n, r["share"]))
        return F.struct(r["pass"].alias("pass"), r["words"].alias("words"), time.alias("time"))

    def positioned(r):
        position = sum((F.lit(whole.get(k, 0.0)) * _before(s, n, r["time"]) for k, s in enumerate(segments)), F.lit(0.0))
        return F.struct(r["pass"].alias("pass"), r["words"].alias("words"), r["time"].alias("time"), F.floor(position).alias("position"))

    readings = F.filter(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), reading), lambda r: r["words"] > 0)
    readings = F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(F.transform(readings, placed), positioned))
    d = d.withColumn("readings", F.coalesce(readings, F.array().cast("array<struct<pass:int,words:bigint,time:double,position:bigint>>")))
    taken = F.aggregate("readings", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "readings")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each reading, range-sorted by position: position, time, doc_id, pass, words."""
    rows = mixed.select("doc_id", F.explode("readings").alias("r")).select("r.position", "r.time", "doc_id", "r.pass", "r.words")
    order = ["position", "time", "doc_id", "pass"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first readings, those without one last."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.get("readings", F.lit(0))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("readings").alias("n_readings"), F.round(first["time"], 6).alias("first_time"), first["position"].alias("at"))
    order = [F.col("at").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")


def _time_sql(k: int, share: str) -> str:
    segments, n = _integral(SCHEDULES[k]), len(SCHEDULES[k]) - 1
    at = lambda j, b, s, r: f"{j / n} + coalesce(least(greatest({share} - {b}, 0) * 2 / nullif({s} + sqrt(greatest({s * s} + greatest({share} - {b}, 0) * {2 * r}, 0)), 0), {1 / n}), 0)"
    cases = " ".join(f"WHEN {share} < {segments[j + 1][0]} THEN {at(j, *x)}" for j, x in enumerate(segments[:-1]))
    return f"CASE {cases} ELSE {at(n - 1, *segments[-1])} END" if cases else at(0, *segments[0])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, {LIMIT} * source_size AS cap, list_extract([{", ".join(f"{area(x)}::DOUBLE" for x in SCHEDULES)}], rank % {len(SCHEDULES)} + 1) AS weight FROM s),
r AS (SELECT cap / weight AS ratio, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS over_
  FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest::DOUBLE AS rest, over_::DOUBLE AS over_ FROM r WHERE rest / over_ <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT w.*, least(rest * weight / over_, cap::DOUBLE) AS target FROM w, l),
f AS (SELECT d.doc_id, size, source_size, target, rank, floor(target)::BIGINT AS goal,
  coalesce(sum(size) OVER (PARTITION BY rank ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, list_filter(list_transform(range({LIMIT}), lambda k: least(size, goal - (k * source_size + first))), lambda x: x > 0) AS words, first / nullif(target, 0) AS share FROM f)
SELECT doc_id, size, source_size, target, coalesce(list_sum(words), 0)::BIGINT AS taken, len(words)::INT AS n_readings,
  CASE WHEN len(words) > 0 THEN round(CASE rank % {len(SCHEDULES)} {" ".join(f"WHEN {k} THEN {_time_sql(k, 'share')}" for k in range(len(SCHEDULES)))} END, 6) END AS first_time
FROM p
"""
