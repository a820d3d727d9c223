"""Ignore rules of every folder, as a table that is joined with the entries below each folder.

The last rule that matches an entry decides: rules of deeper folders come after those of folders above,
later lines after earlier ones, and both after a tree's exclude file and that after a global one.  An
entry below an ignored folder is ignored whatever its own rules say.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages as L
from . import listing

#: folder is "" for the root; level: -2 global, -1 exclude file, else the folder's depth.
RULES = "folder string, level int, line int, pattern string"
EXCLUDE = ".git/info/exclude"


def rules_of(spark: SparkSession, root: str, listed: DataFrame, global_file: str | None = None, names=L.IGNORE_FILES) -> DataFrame:
    """The lines of the ignore files of a listing, one after another where a folder has several."""
    name = F.element_at(F.split("relative", "/"), -1)
    return _rules(spark, root, listed.where(~F.col("is_dir") & name.isin(list(names))).select("relative"), global_file, names)


def rules_above(spark: SparkSession, root: str, paths: DataFrame, column: str = "relative", global_file: str | None = None, names=L.IGNORE_FILES) -> DataFrame:
    """The rules that can concern some paths: those of the folders above them; nothing else is listed."""
    p = F.split(column, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))
    folders = paths.select(F.explode(above).alias("f")).distinct()
    return _rules(spark, root, folders.select(F.explode(F.array(*(F.when(F.col("f") == "", F.lit(n)).otherwise(F.concat("f", F.lit(f"/{n}"))) for n in names))).alias("relative")), global_file, names)


def _rules(spark: SparkSession, root: str, files: DataFrame, global_file: str | None, names) -> DataFrame:
    kind = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("relative", "/"), -1))
    found = listing.contents(spark, root, files)
    folder = F.regexp_replace("relative", r"/?[^/]*\z", "")
    own = found.select(folder.alias("folder"), kind.alias("kind"), F.posexplode(F.split("content", r"\r?\n")).alias("at", "pattern"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    rules = own.select("folder", depth.cast("int").alias("level"), (F.col("kind") * 1_000_000 + F.col("at")).cast("int").alias("line"), "pattern")
    for level, text in ((-1, listing.text(root, EXCLUDE)), (-2, listing.text(global_file) if global_file else None)):
        if text:
            rules = rules.unionByName(spark.createDataFrame([("", level, k, p) for k, p in enumerate(text.splitlines())], RULES))
    return rules


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with regex, back and only_dir in place of the pattern; lines that are none are left out."""

    def run(parts):
        for d in parts:
            got = d["pattern"].map(lambda p: L.rule(p) if p is not None else None)
            have = got.notna()
            out = d.loc[have, ["folder", "level", "line"]].reset_index(drop=True)
            found = got[have].tolist()
            yield out.assign(regex=pd.Series([g[0] for g in found], dtype=object), back=pd.Series([g[1] for g in found], dtype=bool), only_dir=pd.Series([g[2] for g in found], dtype=bool))

    return rules.mapInPandas(run, "folder string, level int, line int, regex string, back boolean, only_dir boolean")


def ignored_paths(paths: DataFrame, rules: DataFrame, column: str = "relative") -> DataFrame:
    """The distinct paths (column) that rules (RULES) ignore.

    Paths share folders: each entry, a folder or a file, is judged once, against the rules of the
    folders above it.  Spark broadcasts the rules while they are few and else splits crowded folders.
    """
    parts = paths.select(F.col(column).alias("path")).where("path <> ''").distinct().withColumn("p", F.split("path", "/"))
    steps = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", F.lit(1), k), "/").alias("entry"), (k < F.size("p")).alias("is_dir")))
    reached = parts.select("path", F.explode(steps).alias("s")).select("path", "s.entry", "s.is_dir")
    entries = reached.select("entry", "is_dir").distinct().withColumn("p", F.split("entry", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.struct(F.array_join(F.slice("p", F.lit(1), k), "/").alias("folder"), F.array_join(F.slice("p", k + 1, F.size("p")), "/").alias("tail")))
    asked = entries.select("entry", "is_dir", F.explode(above).alias("a")).select("entry", "is_dir", "a.folder", "a.tail")
    hits = asked.join(compiled(rules), "folder").where("(is_dir OR NOT only_dir) AND rlike(tail, regex)")
    verdict = hits.groupBy("entry", "is_dir").agg(F.max_by(~F.col("back"), F.struct("level", "line")).alias("out")).where("out")
    return reached.join(verdict, ["entry", "is_dir"], "left_semi").select(F.col("path").alias(column)).distinct()


def without_ignored(files: DataFrame, rules: DataFrame, column: str = "relative") -> DataFrame:
    return files.join(ignored_paths(files, rules, column), column, "left_anti")
