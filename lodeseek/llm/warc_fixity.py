"""Merkle fixity audit of WARC archives and their replicas.

Records are numbered; an archive holds the records of SLOTS numbers, in order, at running byte
offsets.  A leaf is the hash of a record's bytes.  A node covers FAN_OUT numbers of the level below
and hashes its children's hashes with their offset ranges, counted from the node's own start, so that
a record of another length changes no node but those above it.  Node LEVELS up is an archive; above
archives the tree goes on to one root.  Both replicas' trees are built level by level (a level is one
aggregation of a sixteenth of the rows); the audit compares roots and follows only mismatching
branches down to the records, so that intact replicas cost one comparison.

Defined results: all records without a number are record -1, of archive -1 (negative numbers have a
root of their own); several rows of one number are one leaf, whatever their order (sums of their
hashes, so that no task holds them together); null url or content is empty; records of only one
replica are "missing" or "extra"; identical or empty replicas give no rows; a page of any length
is one record; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

#: FAN_OUT == 2 ** FAN_BITS.
SLOTS, FAN_OUT, FAN_BITS = 4096, 16, 4
#: Level of the archives; FAN_OUT ** LEVELS == SLOTS.
LEVELS = 3
NO_NUMBER = -1


def records(pages: DataFrame) -> DataFrame:
    """number and the bytes (as text) of each page's WARC response record."""
    number = F.col("page_id").cast("long")
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.coalesce(number, F.lit(NO_NUMBER).cast("long")).alias("number"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """side, node (the number), hash and bytes of each record."""
    hashed = recs.select("side", F.col("number").alias("node"), F.sha2("record", 256).alias("h"), F.octet_length("record").cast("long").alias("bytes"))
    quarter = lambda k: F.sum(F.conv(F.substring("h", 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string")
    many = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(quarter(k) for k in range(4))), 256)
    return hashed.groupBy("side", "node").agg(F.when(F.count("*") == 1, F.min("h")).otherwise(many).alias("hash"), F.sum("bytes").alias("bytes"))


def levels(primary: DataFrame, replica: DataFrame) -> list[DataFrame]:
    """The nodes of both trees (side 0 and 1), a table for each level from the one above the records up
    to the roots: side, node, hash, bytes, children (array of node, hash, start, end; offsets from the
    node's start)."""
    both = primary.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1)))
    below = written(leaves(both), "leaves")
    top = below.agg(F.max(F.abs("node"))).first()[0] or 0
    out = []
    while len(out) < LEVELS or FAN_OUT ** len(out) <= top:
        child = F.struct("node", "hash", "bytes")
        level = below.groupBy("side", F.shiftright("node", FAN_BITS).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("bytes").alias("bytes"))
        # FAN_OUT children at most
        start = "aggregate(slice(c, 1, i), 0L, (a, y) -> a + y.bytes)"
        level = level.withColumn("children", F.expr(f"transform(c, (x, i) -> named_struct('node', x.node, 'hash', x.hash, 'start', {start}, 'end', {start} + x.bytes))"))
        text = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["node"], x["hash"], x["start"], x["end"])), ";")
        below = written(level.select("side", F.col("up").alias("node"), F.sha2(text, 256).alias("hash"), "bytes", "children"), f"level-{len(out) + 1}")
        out.append(below)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Leaves where the trees differ: number, status, both hashes, and the primary's byte offsets
    within its archive."""
    tree = levels(primary, replica)
    nodes = [tree[-1].where(F.col("side") == side).select("node", "hash", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")) for side in (0, 1)]
    found = _mismatches(*nodes)
    for k in range(len(tree), 0, -1):
        if k < len(tree):
            found = written(found, f"mismatch-{k}")
        # offsets run within an archive: they begin anew at its level
        begun = F.col("begun") if k < LEVELS else F.lit(0).cast("long")
        opened = tree[k - 1].join(found.select("node", F.coalesce("start", F.lit(0)).alias("begun")), "node").select("side", "begun", F.explode("children").alias("c"))
        opened = opened.select("side", "c.node", "c.hash", (begun + F.col("c.start")).alias("start"), (begun + F.col("c.end")).alias("end"))
        found = _mismatches(*(opened.where(F.col("side") == side).drop("side") for side in (0, 1)))
    status = F.when(F.col("replica_hash").isNull(), "missing").when(F.col("primary_hash").isNull(), "extra").otherwise("changed")
    return found.select(F.col("node").alias("number"), status.alias("status"), "primary_hash", "replica_hash", "start", "end")


def _mismatches(x: DataFrame, y: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or which only one side has."""
    x = x.withColumnRenamed("hash", "primary_hash")
    y = y.select("node", F.col("hash").alias("replica_hash"))
    return x.join(y, "node", "full_outer").where(~F.col("primary_hash").eqNullSafe(F.col("replica_hash")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults, for the query and tests: bits changed, records lost and added."""
    changed = F.when(F.col("page_id") % 97 == 5, F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).when(F.col("page_id") % 101 == 7, F.translate("html", "e", "f")).otherwise(F.col("html"))
    return pages.where("page_id IS NULL OR page_id % 211 <> 9").withColumn("html", changed)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = audit(records(pages), records(damaged(pages)))
    return found.select(F.col("number").alias("page_id"), "status", "primary_hash", "replica_hash", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))


_RECORD = "'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Record-ID: <urn:page:' || page_id || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'Content-Length: ' || strlen(coalesce({html}, '')) || crlf || crlf || coalesce({html}, '') || crlf || crlf"
SQL = f"""
WITH p AS (
  SELECT page_id, url, html, chr(13) || chr(10) AS crlf,
         CASE WHEN page_id % 97 = 5 THEN coalesce(html, '') || ' ' WHEN page_id % 101 = 7 THEN translate(html, 'e', 'f') ELSE html END AS other
  FROM pages
), r AS (
  SELECT page_id, {_RECORD.format(html="html")} AS a, CASE WHEN page_id % 211 <> 9 THEN {_RECORD.format(html="other")} END AS b FROM p
), o AS (
  SELECT page_id, sha256(a) AS primary_hash, sha256(b) AS replica_hash,
         (sum(strlen(a)) OVER (PARTITION BY page_id // {SLOTS} ORDER BY page_id))::BIGINT AS end_offset, strlen(a) AS n FROM r
)
SELECT page_id, CASE WHEN replica_hash IS NULL THEN 'missing' ELSE 'changed' END AS status, primary_hash, replica_hash,
       (end_offset - n)::BIGINT AS start_offset, end_offset
FROM o WHERE replica_hash IS DISTINCT FROM primary_hash
"""
