"""Directory trees as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ignore, listing
from . import languages as L

#: Hidden names, and the names that Spark's listings leave out.
HIDDEN, UNSEEN = r"(?:\A|/)\.[^/]", r"(?:\A|/)[._][^/]"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: path, relative, size, mtime, content.  Columns not asked for, the
    content above all, are not read."""
    return _shaped(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root)


def named(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The files among some paths below ``root``, as ``tree`` has them; paths that are not there are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        if fs.exists(target) and fs.getFileStatus(target).isFile():
            there.append(path)
    if not there:
        return tree(spark, root).limit(0)
    return _shaped(spark.read.format("binaryFile").option("ignoreMissingFiles", True).load([_literal(p) for p in there]), root)


def _literal(path: str) -> str:
    """A path whose characters are no pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _shaped(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/")
    plain = F.regexp_replace("path", r"\A[a-z]+:/{1,3}(?=/)|\Afile:", "")
    tail = F.regexp_replace(plain, r"\A/*", "/")
    start = len(base.split("://", 1)[-1].split(":", 1)[-1]) if "://" in base else len(base)
    return files.select(tail.alias("path"), F.substr(tail, F.lit(start + 2), F.length(tail)).alias("relative"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")


def ignore_patterns(spark: SparkSession, root: str, names=L.IGNORE_FILES) -> list[str]:
    """Lines of the ignore files at the root, in order."""
    found: list[str] = []
    for name in names:
        found += (small_text(spark, f"{root.rstrip('/')}/{name}") or "").splitlines()
    return found


def small_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None; by the file system, for Spark's readers skip hidden names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode(errors="replace")
    finally:
        stream.close()


def walk(spark: SparkSession, root: str, respect_ignore: bool = True, include_hidden: bool = False, global_file: str | None = None) -> DataFrame:
    """The files to index: path, relative, size, mtime, language.  Path rules, those of every folder's
    ignore files too, come before any content is read; the content test reads what is left."""
    entries = listing.listed(spark, root)
    unseen = entries.where(F.col("relative").rlike(UNSEEN) & ~L.binary_by_extension(F.col("relative")))
    unseen = unseen if include_hidden else unseen.where(~F.col("relative").rlike(HIDDEN))
    files = tree(spark, root).where(~F.col("relative").rlike(UNSEEN)).unionByName(listing.files_of(spark, root, unseen))
    if respect_ignore:
        files = ignore.without_ignored(files, ignore.rules_of(spark, root, entries, global_file))
    return indexable(files, include_hidden)


def indexable(d: DataFrame, include_hidden: bool = False) -> DataFrame:
    """The files of a tree that are to be indexed, with their language."""
    d = d.where(~L.in_excluded_dir(F.col("path")) & ~L.binary_by_extension(F.col("path")))
    if not include_hidden:
        d = d.where(~F.col("relative").rlike(HIDDEN))
    d = d.withColumn("language", L.language(F.col("path"))).where(L.is_indexable(F.col("language")))
    return d.where(~L.binary_by_content(F.col("content")))


def readable(files: DataFrame) -> DataFrame:
    """Files whose content is UTF-8, as text in ``content``, with dbt told from SQL, and its hash."""
    d = files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where("text IS NOT NULL")
    d = d.withColumn("content_hash", F.sha2("content", 256)).withColumn("content", F.col("text")).drop("text")
    return d.withColumn("language", F.when((F.col("language") == "Sql") & L.is_dbt(F.col("content")), "Dbt").otherwise(F.col("language")))


def read_report(files: DataFrame, content: str = "content") -> DataFrame:
    """(outcome, files, bytes): what becomes of files when they are read: text, binary, or not UTF-8."""
    raw = F.col(content)
    outcome = F.when(L.binary_by_content(raw), "binary").when(~F.is_valid_utf8(raw.cast("string")), "not UTF-8").otherwise("text")
    return files.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("files"), F.sum(F.octet_length(raw).cast("long")).alias("bytes"))


def walk_stats(files: DataFrame) -> DataFrame:
    """One row per language, most files first."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "language")
