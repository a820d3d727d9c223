"""Chunks of texts: line windows, splits of oversized chunks, gaps and contexts.

Line numbers count from 0, ends are exclusive.  Each row is cut within itself: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_LINES, MAX_BYTES, OVERLAP, CONTEXT = 100, 2000, 10, 3


def _windows(n, size: int, overlap: int):
    stride = max(1, size - overlap)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def line_windows(df: DataFrame, text: str, size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of lines; adds start_line, end_line, content, hash."""
    d = df.withColumn("_lines", T.lines(F.col(text)))
    d = d.withColumn("start_line", F.explode(_windows(F.size("_lines"), size, overlap)))
    d = d.withColumn("end_line", F.least(F.col("start_line") + size, F.size("_lines")))
    d = d.withColumn("content", F.array_join(F.slice("_lines", F.col("start_line") + 1, F.col("end_line") - F.col("start_line")), "\n"))
    return d.withColumn("hash", F.sha2("content", 256)).drop("_lines")


def split_oversized(chunks: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks above either limit as numbered parts; the hash is of the part without its header.

    Needs start_line, content, signature, docstring; adds is_complete, split_index, n_parts, hash.
    """
    d = chunks.withColumn("_lines", T.lines(F.col("content")))
    big = (F.size("_lines") > max_lines) | (F.octet_length("content") > max_bytes)
    d = d.withColumn("_starts", F.when(big, _windows(F.size("_lines"), max_lines, overlap)))
    d = d.withColumn("n_parts", F.coalesce(F.size("_starts"), F.lit(0)))
    d = d.withColumn("n_parts", F.when(F.col("_starts").isNull(), 0).otherwise(F.col("n_parts")))
    d = d.select("*", F.posexplode(F.coalesce(F.col("_starts"), F.array(F.lit(0)))).alias("_k", "_s"))
    part = F.col("n_parts") > 0
    body = F.array_join(F.slice("_lines", F.col("_s") + 1, F.lit(max_lines)), "\n")
    header = F.concat(F.lit("// [Part "), F.col("_k") + 1, F.lit("/"), F.col("n_parts"), F.lit("] "), F.coalesce("signature", F.lit("(continued)")), F.lit("\n"))
    d = d.withColumn("_body", F.when(part, body).otherwise(F.col("content")))
    end = F.least(F.col("_s") + max_lines, F.size("_lines"))
    d = d.withColumn("end_line", F.when(part, F.col("start_line") + end).otherwise(F.col("start_line") + F.size("_lines")))
    d = d.withColumn("start_line", F.col("start_line") + F.col("_s")).withColumn("hash", F.sha2("_body", 256))
    d = d.withColumn("content", F.when(part, F.concat(header, "_body")).otherwise(F.col("_body")))
    d = d.withColumn("docstring", F.when(~part | (F.col("_k") == 0), F.col("docstring")))
    d = d.withColumn("is_complete", ~part).withColumn("split_index", F.when(part, F.col("_k")))
    if "string_literals" in chunks.columns:
        d = d.withColumn("string_literals", F.when(~part, F.col("string_literals")).otherwise(F.array().cast("array<string>")))
    return d.drop("_lines", "_starts", "_k", "_s", "_body")


def context_windows(chunks: DataFrame, text: str, n: int = CONTEXT) -> DataFrame:
    """Adds context_prev and context_next: the lines around start_line .. end_line, null if blank."""
    source = T.lines(F.col(text))
    first = F.greatest(F.col("start_line") - n, F.lit(0))
    before = F.array_join(F.slice(source, first + 1, F.col("start_line") - first), "\n")
    after = F.array_join(F.slice(source, F.col("end_line") + 1, F.lit(n)), "\n")
    return chunks.withColumn("context_prev", F.when(~T.is_blank(before), before)).withColumn("context_next", F.when(~T.is_blank(after), after))


def gap_chunks(df: DataFrame, text: str, covered: str) -> DataFrame:
    """Maximal runs of lines outside the ranges in ``covered`` (array of start_line, end_line), unless
    blank; adds start_line, end_line, content, kind."""
    d = df.withColumn("_lines", T.lines(F.col(text)))
    # the end of each gap is the start of a range, the start is the furthest end before it
    d = d.withColumn("_sorted", F.array_sort(F.concat(F.transform(F.col(covered), lambda r: F.struct(r["start_line"].cast("int").alias("s"), r["end_line"].cast("int").alias("e"))), F.array(F.struct(F.size("_lines").alias("s"), F.size("_lines").alias("e"))))))
    step = F.expr("aggregate(_sorted, named_struct('to', 0, 'g', cast(array() as array<struct<s:int,e:int>>)), (a, r) -> named_struct('to', greatest(a.to, r.e), 'g', CASE WHEN r.s > a.to THEN a.g || array(named_struct('s', a.to, 'e', r.s)) ELSE a.g END)).g")
    d = d.withColumn("_g", F.explode(step)).withColumn("start_line", F.col("_g.s")).withColumn("end_line", F.col("_g.e"))
    d = d.withColumn("content", F.array_join(F.slice("_lines", F.col("start_line") + 1, F.col("end_line") - F.col("start_line")), "\n"))
    return d.where(~T.is_blank("content")).withColumn("kind", F.lit("Block")).drop("_lines", "_sorted", "_g")
