"""Listings of folder trees, hidden names included, by tasks: one pass for each level of depth.

Spark's own file sources leave out names that begin with a dot or an underscore.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import languages as L

LISTED = "relative string, is_dir boolean, size long, mtime long"


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def listed(spark: SparkSession, root: str, skip=L.EXCLUDED_DIRS) -> DataFrame:
    """Every entry below ``root`` (relative, is_dir, size, mtime), but for what lies in folders of the
    names ``skip``."""
    skip = set(skip)

    def children(parts):
        files, base = _at(root)
        for d in parts:
            rows = []
            for folder in d["relative"]:
                below = f"{base.rstrip('/')}/{folder}" if folder else base
                for i in files.get_file_info(fs.FileSelector(below, allow_not_found=True)):
                    name = i.base_name
                    if i.type == fs.FileType.Directory and name in skip:
                        continue
                    rows.append((f"{folder}/{name}" if folder else name, i.type == fs.FileType.Directory, i.size or 0, int(i.mtime.timestamp()) if i.mtime else 0))
            yield pd.DataFrame(rows, columns=["relative", "is_dir", "size", "mtime"])

    level, levels = spark.createDataFrame([("",)], "relative string"), []
    while not levels or not level.isEmpty():
        found = written(level.mapInPandas(children, LISTED), "listed")
        levels.append(found)
        level = found.where("is_dir").select("relative").repartition(spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, levels)


def contents(spark: SparkSession, root: str, relatives: DataFrame) -> DataFrame:
    """(relative, content) of those files (relative) that are there, read by tasks; bytes that are no
    UTF-8 are replaced."""

    def read(parts):
        files, base = _at(root)
        for d in parts:
            rows = []
            for r in d["relative"]:
                at = f"{base.rstrip('/')}/{r}"
                if files.get_file_info(at).type == fs.FileType.File:
                    with files.open_input_stream(at) as f:
                        rows.append((r, f.read().decode(errors="replace")))
            yield pd.DataFrame(rows, columns=["relative", "content"])

    return relatives.select("relative").mapInPandas(read, "relative string, content string")


def text(root: str, relative: str | None = None) -> str | None:
    """A small file's text, or None."""
    files, base = _at(root)
    at = f"{base.rstrip('/')}/{relative}" if relative else base
    if files.get_file_info(at).type != fs.FileType.File:
        return None
    with files.open_input_stream(at) as f:
        return f.read().decode(errors="replace")


def files_of(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """Files of a listing with their bytes, in the columns of ``files.tree``."""

    def read(parts):
        files, base = _at(root)
        for d in parts:
            for row in d.itertuples(index=False):
                with files.open_input_stream(f"{base.rstrip('/')}/{row.relative}") as f:
                    yield pd.DataFrame([(f"{base.rstrip('/')}/{row.relative}", row.relative, row.size, row.mtime, f.read())], columns=["path", "relative", "size", "mtime", "content"])

    return entries.where(~F.col("is_dir")).select("relative", "size", "mtime").mapInPandas(read, "path string, relative string, size long, mtime long, content binary")
