"""Indexes: segments of chunks, vectors, postings and file metadata as Parquet, and a log of versions.

A version is one entry of the log, so a reader never sees half of it.  An incremental run re-chunks
changed files only and writes a segment of its own.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import ann, block_max, changes, chunking, embedding, extractors, fts, ranking, vector_search
from ..operators.embedding_cache import EmbeddingCache
from ..sources import files as S
from ..sources import languages as L
from ..storage import written
from .log import Log

FIELDS = {"content": "content", "signature": "signature", "string_literals": "literals"}
CHUNK_COLUMNS = ["path", "start_line", "end_line", "kind", "content", "context", "signature", "docstring", "is_complete", "split_index", "hash", "context_prev", "context_next", "string_literals"]
RETRIEVE = 200


def chunk_files(files: DataFrame) -> DataFrame:
    """files: path, language, content.  Definitions, the gaps between them, and windows for languages
    without an extractor; contexts before, splits after."""
    known = files.where(L.has_extractor(F.col("language"))).select("path", "language", "content")
    found = extractors.definitions(known)
    per = found.groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("covered"))  # one file's
    source = known.select("path", F.col("content").alias("source"))
    gaps = chunking.gap_chunks(source.join(per, "path", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<struct<start_line:int,end_line:int>>"))), "source", "covered")
    empty = F.lit(None).cast("string")
    gaps = gaps.select("path", "start_line", "end_line", "kind", "content", F.array(F.concat(F.lit("File: "), "path")).alias("context"), empty.alias("signature"), empty.alias("docstring"))
    parsed = found.select(*gaps.columns).unionByName(gaps).join(source, "path")
    parsed = chunking.context_windows(parsed, "source").drop("source").withColumn("string_literals", T.string_literals("content"))
    parsed = chunking.split_oversized(parsed.drop("end_line"))
    parsed = parsed.withColumn("context_prev", F.when(F.col("is_complete"), F.col("context_prev"))).withColumn("context_next", F.when(F.col("is_complete"), F.col("context_next")))
    plain = files.where(~L.has_extractor(F.col("language"))).select("path", "content").withColumnRenamed("content", "source")
    plain = chunking.line_windows(plain, "source").select(
        "path", "start_line", "end_line", F.lit("Block").alias("kind"), "content", F.array(F.concat(F.lit("File: "), "path")).alias("context"), empty.alias("signature"), empty.alias("docstring"),
        F.lit(True).alias("is_complete"), F.lit(None).cast("int").alias("split_index"), "hash", empty.alias("context_prev"), empty.alias("context_next"), T.string_literals("content").alias("string_literals"),
    )
    return parsed.select(*CHUNK_COLUMNS).unionByName(plain.select(*CHUNK_COLUMNS))


class Conflict(RuntimeError):
    """Other writers came first, time and again."""


class Index:
    """One database below ``root``: tables in segments, and a log of numbered versions.

    A version names its segments.  A run writes what is new as one more segment and the ids that are
    gone as tombstones, so it costs what changed, not what is there; readers take the segments of their
    version without the rows that are gone.  A writer whose number is taken starts again from the
    version that took it, so nothing of either is lost.  Segments of like size are merged once there
    are ``FAN``; ``vacuum`` removes what no kept version names.
    """

    SCHEMAS = {
        "chunks": "chunk_id long, path string, start_line int, end_line int, kind string, content string, context array<string>, signature string, docstring string, is_complete boolean, split_index int, hash string, context_prev string, context_next string, string_literals array<string>",
        "vectors": "chunk_id long, embedding array<float>, cell int",
        "postings": "field string, term string, id long, tf long, positions array<int>, dl long, block long",
        "blocks": "field string, term string, block long, n long, max_tf long, min_dl long",
        "files": f"path string, hash string, mtime long, size long, chunk_ids array<long>, chunk_count int, lengths struct<{','.join(f'{f}:bigint' for f in FIELDS)}>, gone boolean, commit long",
        "tombstones": "chunk_id long",
    }
    #: Segments of about one size that are merged, and the rows from which sizes are told apart.
    FAN, LEAST_ROWS = 4, 1000
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, root: str, embedder: embedding.Embedder | None = None, model: str = embedding.DEFAULT_MODEL, cache: EmbeddingCache | None = None):
        self.spark, self.root, self.model, self.cache = spark, root.rstrip("/"), model, cache
        self.embedder = embedder or embedding.HashingArrowEmbedder(embedding.model(model).dimensions)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.log = Log(spark, f"{self.root}/log")
        self._marks: dict[str, list[list[float]]] = {}

    # -- versions
    @property
    def version(self) -> int | None:
        found = self.log.versions()
        return found[-1] if found else None

    def entry(self, version: int | None = None) -> dict | None:
        """What a version, by default the last, names."""
        if version is not None:
            return self.log.read(version)
        found = self.log.latest()
        return found[1] if found else None

    def metadata(self) -> dict:
        entry = self.entry()
        return entry["metadata"] if entry else {"model_name": embedding.DEFAULT_MODEL, "dimensions": 384, "version": 1}

    def table(self, name: str, segments: list[str]) -> DataFrame:
        """A table's rows in some segments, those that are gone included."""
        if not segments:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        rows = self.spark.read.schema(self.SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/segment={s}" for s in segments))
        return rows.drop("segment")

    def live(self, name: str, entry: dict, segments: list[str] | None = None) -> DataFrame:
        """The same without those that are gone.  Spark broadcasts the tombstones while they are few."""
        rows = self.table(name, [s["name"] for s in entry["segments"] if s["rows"]] if segments is None else segments)
        if name == "blocks" or not entry["tombstones"]:
            return rows
        key = "id" if name == "postings" else "chunk_id"
        return rows.join(self.table("tombstones", entry["tombstones"]).withColumnRenamed("chunk_id", key), key, "left_anti")

    def file_rows(self, entry: dict) -> DataFrame:
        """The last row of each file, removed ones included."""
        return changes.latest(self.table("files", [s["name"] for s in entry["segments"]]), "path", "commit")

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """chunks, vectors, postings, blocks or files of a version, by default the last."""
        entry = self.entry(version)
        if entry is None:
            return None
        return self.file_rows(entry).where("NOT gone").drop("gone", "commit", "lengths") if name == "files" else self.live(name, entry)

    def totals(self, entry: dict) -> DataFrame:
        """(field, n, avgdl) over the live chunks."""
        rows = [(f, n, total / n if n else 0.0) for f, (n, total) in entry["totals"].items()]
        return self.spark.createDataFrame(rows, "field string, n long, avgdl double")

    # -- writing
    def index(self, source: str, full: bool = False, dry_run: bool = False) -> DataFrame | None:
        """Index a tree; with a version present only what changed.  dry_run: the statuses alone."""
        entry = self.entry()
        stored = entry["metadata"] if entry else None
        if stored and not full and stored["dimensions"] != self.embedder.dimensions:
            raise ValueError(f"the index has {stored['dimensions']} dimensions ({stored['model_name']}), not {self.embedder.dimensions}; index in full")
        # another model's vectors cannot stand beside the stored ones, even of equal length
        full = full or bool(stored and stored["model_name"] != self.model)
        files = S.readable(S.walk(self.spark, source))
        snapshot = files.select("path", F.col("content_hash").alias("hash"), "mtime", "size")

        def status(old: dict | None) -> DataFrame:
            if old is None or full:
                return snapshot.select("path", F.lit("new").alias("status"))
            known = self.file_rows(old).where("NOT gone")
            return changes.change_detect(known, snapshot).select("path", "status")

        if dry_run:
            return status(entry)
        self._write(status, files, full)
        return None

    def apply(self, status: DataFrame, files: DataFrame) -> int:
        """Brings the paths of (path, status: new, changed or deleted) up to date and touches no other;
        returns the version.  files: readable files, the new and changed ones among them."""
        return self._write(lambda _: status, files, False)

    def delete_files(self, paths: DataFrame) -> DataFrame:
        """Removes the files of a table of paths; returns the ids of the chunks that went (chunk_id)."""
        gone = paths.select("path").distinct().withColumn("status", F.lit("deleted"))
        before = self.version or 0
        after = self._write(lambda old: gone.join(self.file_rows(old).where("NOT gone"), "path", "left_semi") if old else gone.limit(0), None, False)
        return self.table("tombstones", [t for t in self.entry(after)["tombstones"] if t == self.entry(after)["made"]] if after > before else [])

    def _write(self, status_of, files: DataFrame | None, full: bool) -> int:
        """Writes a segment and commits it, again from the newest version where another writer came first."""
        for _ in range(self.ATTEMPTS):
            number, old = self.log.latest() or (0, None)
            made = uuid.uuid4().hex[:12]
            status = written(status_of(old).where("status <> 'unchanged'"), "status")
            if number and not full and status.isEmpty():
                return number
            entry = self._segment(number + 1, None if full else old, made, status, files)
            if self.log.put(number + 1, entry):
                self.compact()
                return number + 1
            self._drop(made)
        raise Conflict(f"{self.root}: other writers came first {self.ATTEMPTS} times")

    def _segment(self, number: int, old: dict | None, made: str, status: DataFrame, files: DataFrame | None) -> dict:
        """Writes the segment ``made`` and returns the version's entry."""
        metadata = {"model_name": self.model, "dimensions": self.embedder.dimensions, "version": 1, "last_full_index": old["metadata"]["last_full_index"] if old else int(time.time())}
        entry = {"segments": [], "tombstones": [], "next_id": 0, "totals": {f: [0, 0] for f in FIELDS}, "marks": None, "probes": None} | (old or {}) | {"made": made, "metadata": metadata}
        totals = {f: list(x) for f, x in entry["totals"].items()}
        sums = [F.sum("chunk_count").alias("n"), *(F.sum(f"lengths.{f}").alias(f) for f in FIELDS)]
        if old:
            gone = self.file_rows(old).where("NOT gone").join(status, "path", "left_semi")
            gone.select(F.explode("chunk_ids").alias("chunk_id")).write.parquet(f"{self.root}/tombstones/segment={made}")
            row = gone.agg(*sums).first()
            if row.n:
                entry["tombstones"] = [*entry["tombstones"], made]
                totals = {f: [n - row.n, total - row[f]] for f, (n, total) in totals.items()}
        redo = status.where("status IN ('new', 'changed')").select("path")
        rows = status.where("status = 'deleted'").select("path", F.lit(True).alias("gone"))
        segment = {"name": made, "rows": 0, "cells": {}}
        if files is not None:
            own = written(files.join(redo, "path", "left_semi"), "files")  # read once
            fresh = self._fresh(own, entry["next_id"])
            if entry["marks"] is None:
                entry["marks"], entry["probes"] = self._fit(fresh, made)
            self._put(made, fresh, fresh, self._postings(fresh), entry["marks"])
            lens = fts.lengths(self._literal_text(fresh), "chunk_id", FIELDS).groupBy("id").agg(*(F.sum(F.when(F.col("field") == f, F.col("dl"))).alias(f) for f in FIELDS))
            per = fresh.select("path", F.col("chunk_id").alias("id")).join(lens, "id").groupBy("path").agg(
                F.array_sort(F.collect_list("id")).alias("chunk_ids"), F.count("*").cast("int").alias("chunk_count"), F.struct(*(F.sum(f).alias(f) for f in FIELDS)).alias("lengths"),
            )  # a list holds one file's chunks
            here = own.select("path", F.col("content_hash").alias("hash"), "mtime", "size").join(per, "path", "left")
            rows = here.withColumn("gone", F.lit(False)).unionByName(rows, allowMissingColumns=True)
        self._write_files(rows.withColumn("commit", F.lit(number)), made)
        if files is not None:
            row = self.table("files", [made]).agg(*sums, F.max(F.array_max("chunk_ids")).alias("top")).first()
            if row.n:
                segment |= {"rows": row.n, "cells": self._cells(made)}
                entry["next_id"] = row.top + 1
                totals = {f: [n + row.n, total + row[f]] for f, (n, total) in totals.items()}
        return entry | {"segments": [*entry["segments"], segment], "totals": totals}

    def _write_files(self, rows: DataFrame, made: str) -> None:
        shape = StructType.fromDDL(self.SCHEMAS["files"])
        have = set(rows.columns)
        rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape)).write.parquet(f"{self.root}/files/segment={made}")

    def _fresh(self, files: DataFrame, first: int) -> DataFrame:
        """The chunks of files with ids and vectors, written once for all that is made from them."""
        chunks = changes.with_ids(written(chunk_files(files), "cut"), ["path", "start_line", "end_line", "split_index", "hash"], first)
        if self.cache is None:
            return written(embedding.embed_chunks(chunks, self.embedder), "chunks")
        return self.cache.embed(written(chunks, "chunks"), self.embedder)

    def _put(self, made: str, chunks: DataFrame, vectors: DataFrame, postings: DataFrame, marks: str) -> None:
        """Writes the tables of a segment, each in the order in which it is looked up, so that the extremes
        of row groups tell which of them a lookup needs."""
        names = [f.name for f in StructType.fromDDL(self.SCHEMAS["chunks"])]
        at = lambda name: f"{self.root}/{name}/segment={made}"
        chunks.select(*names).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(at("chunks"))
        ann.write(ann.with_cells(vectors.select("chunk_id", "embedding"), self.marks(marks)), at("vectors"), "chunk_id")
        postings.repartitionByRange("term", "field", "id").sortWithinPartitions("term", "field", "id").write.parquet(at("postings"))
        block_max.block_table(self.table("postings", [made])).repartitionByRange("term").sortWithinPartitions("term", "block").write.parquet(at("blocks"))

    @staticmethod
    def _literal_text(chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("literals", F.array_join("string_literals", " "))

    def _postings(self, chunks: DataFrame) -> DataFrame:
        return block_max.with_blocks(fts.all_postings(self._literal_text(chunks), "chunk_id", FIELDS))

    def _fit(self, vectors: DataFrame, name: str) -> tuple[str, int | None]:
        """Fits and keeps landmarks, at most ann.MOST_CELLS vectors; their name and the cells to probe."""
        marks = ann.landmarks(vectors, "chunk_id")
        self.spark.createDataFrame(list(enumerate(marks)), "cell int, landmark array<float>").coalesce(1).write.parquet(f"{self.root}/marks/{name}")
        return name, ann.tuned_probes(vectors, marks, "chunk_id")

    def marks(self, name: str) -> list[list[float]]:
        if name not in self._marks:
            self._marks[name] = [list(r.landmark) for r in self.spark.read.schema("cell int, landmark array<float>").parquet(f"{self.root}/marks/{name}").orderBy("cell").collect()]  # MOST_CELLS rows at most
        return self._marks[name]

    def _cells(self, made: str) -> dict[str, int]:
        """Rows of each cell of a segment: at most ann.MOST_CELLS numbers."""
        return {str(r.cell): r["count"] for r in self.table("vectors", [made]).groupBy("cell").count().collect()}

    # -- merging and cleaning
    def _level(self, segment: dict) -> int:
        rows, level = segment["rows"], 0
        while rows >= self.LEAST_ROWS:
            rows, level = rows // self.FAN, level + 1
        return level

    def compact(self, full: bool = False) -> int | None:
        """Merges segments of one size where there are FAN of them, so that a row is rewritten as often
        as sizes grow; full: all segments, with landmarks fitted anew.  Returns the version, None if
        there was nothing to merge.  A writer in between wins: merging is tried again later."""
        done = None
        while found := self.log.latest():
            number, old = found
            levels: dict[int, list[str]] = {}
            for s in old["segments"]:
                levels.setdefault(self._level(s), []).append(s["name"])
            merge = [s["name"] for s in old["segments"]] if full else next((x for _, x in sorted(levels.items()) if len(x) >= self.FAN), [])
            if len(merge) < 2 and not (full and merge):
                return done
            made = uuid.uuid4().hex[:12]
            if not self.log.put(number + 1, self._merged(old, merge, made, full)):
                self._drop(made)
                return done
            done = number + 1
            if full:
                return done
        return done

    def _merged(self, old: dict, merge: list[str], made: str, refit: bool) -> dict:
        filled = [s["name"] for s in old["segments"] if s["name"] in merge and s["rows"]]
        others = [s for s in old["segments"] if s["name"] not in merge]
        vectors = self.live("vectors", old, filled).drop("cell")
        marks, probes = self._fit(vectors, made) if refit or old["marks"] is None else (old["marks"], old["probes"])
        self._put(made, self.live("chunks", old, filled), vectors, self.live("postings", old, filled), marks)
        files = changes.latest(self.table("files", merge), "path", "commit")
        # a removed file's row is needed while another segment may have an older one
        self._write_files(files if others else files.where("NOT gone"), made)
        rest = [s["name"] for s in others if s["rows"]]
        tombstones = []
        if old["tombstones"] and rest:
            kept = self.table("tombstones", old["tombstones"]).join(self.table("chunks", rest).select("chunk_id"), "chunk_id", "left_semi")
            kept.write.parquet(f"{self.root}/tombstones/segment={made}")
            tombstones = [made] if not self.table("tombstones", [made]).isEmpty() else []
        segment = {"name": made, "rows": self.table("chunks", [made]).count(), "cells": self._cells(made)}
        return old | {"segments": [segment, *others], "tombstones": tombstones, "marks": marks, "probes": probes, "made": made}

    def _drop(self, made: str) -> None:
        for name in self.SCHEMAS:
            self._fs.delete(self._fs_path(f"{self.root}/{name}/segment={made}"), True)
        self._fs.delete(self._fs_path(f"{self.root}/marks/{made}"), True)

    def vacuum(self, keep: int = 1, older_than: float = 3600) -> int:
        """Forgets all but the last ``keep`` versions and removes what only those named.  Folders that
        are younger than ``older_than`` seconds stay: a writer may not have committed them yet.
        Returns the number of folders removed."""
        numbers = self.log.versions()[-keep:]
        if not numbers:
            return 0
        entries = [self.log.read(n) for n in numbers]
        used = {s["name"] for e in entries for s in e["segments"]} | {t for e in entries for t in e["tombstones"]} | {e["marks"] for e in entries}
        self.log.forget(numbers[0])
        removed = 0
        for name in (*self.SCHEMAS, "marks"):
            at = self._fs_path(f"{self.root}/{name}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if s.getPath().getName().removeprefix("segment=") not in used and s.getModificationTime() / 1000 < time.time() - older_than:
                    removed += self._fs.delete(s.getPath(), True)
        return removed

    def size(self) -> dict:
        """Bytes of what the current version names, and bytes a chunk."""
        entry = self.entry()
        if entry is None:
            return {"bytes": 0, "bytes_per_chunk": 0.0}
        folders = [f"{name}/segment={s['name']}" for name in self.SCHEMAS if name != "tombstones" for s in entry["segments"]] + [f"tombstones/segment={t}" for t in entry["tombstones"]]
        paths = [self._fs_path(f"{self.root}/{f}") for f in folders]
        total = sum(self._fs.getContentSummary(p).getLength() for p in paths if self._fs.exists(p))
        return {"bytes": total, "bytes_per_chunk": total / max(1, next(iter(entry["totals"].values()))[0])}

    def has_keywords(self) -> bool:
        """Whether the version has its full text; without it a search is by vectors alone."""
        entry = self.entry()
        filled = [s["name"] for s in entry["segments"] if s["rows"]] if entry else []
        return all(self._fs.exists(self._fs_path(f"{self.root}/{name}/segment={s}")) for name in ("postings", "blocks") for s in filled)

    def clear(self) -> None:
        self._fs.delete(self._fs_path(self.root), True)

    # -- reading
    def stats(self) -> dict:
        entry = self.entry()
        if entry is None:
            return {"total_chunks": 0, "total_files": 0, "indexed": False, "dimensions": self.embedder.dimensions}
        chunks, files = next(iter(entry["totals"].values()))[0], self.read("files").where("chunk_count > 0").count()
        return {"total_chunks": chunks, "total_files": files, "indexed": chunks > 0, "dimensions": entry["metadata"]["dimensions"]}

    def chunk(self, chunk_id: int) -> dict | None:
        row = self.read("chunks").where(F.col("chunk_id") == chunk_id).first()
        return row.asDict(recursive=True) if row else None

    def file_chunks(self, path: str) -> DataFrame:
        return ranking.file_chunks(self.read("chunks"), path)

    def embed_query(self, query: str) -> list[float]:
        return list(self.spark.createDataFrame([(query,)], "q string").select(self.embedder.column(F.col("q"))).first()[0])

    def probed(self, entry: dict, vector: list[float], limit: int, probes: int | None = None) -> list[int]:
        """The cells to read for a query: the nearest ones, more where they are short of rows."""
        marks = self.marks(entry["marks"])
        order = ann.nearest_cells(vector, marks, len(marks))
        least = (entry["probes"] or len(marks)) if probes is None else probes
        have, gone = 0, sum(s["rows"] for s in entry["segments"]) - next(iter(entry["totals"].values()))[0]
        for k, cell in enumerate(order):
            if k >= least and have - gone >= limit:
                return order[:k]
            have += sum(s["cells"].get(str(cell), 0) for s in entry["segments"])
        return order

    def vector_hits(self, query: str | list[float], limit: int, probes: int | None = None) -> DataFrame:
        """(id, cosine, score) of the nearest chunks; only the probed cells' files are read."""
        entry = self.entry()
        vector = self.embed_query(query) if isinstance(query, str) else query
        if entry["marks"] is None or not self.marks(entry["marks"]):
            return vector_search.top_k(self.live("vectors", entry), vector, limit, "chunk_id")
        stored = self.live("vectors", entry).where(F.col("cell").isin(self.probed(entry, vector, limit, probes)))
        return vector_search.top_k(stored, vector, limit, "chunk_id")

    def keyword_hits(self, query: str, limit: int, mode: str = "and") -> DataFrame:
        """(id, score) of the best chunks.  Plain words that must all be there are looked up in blocks;
        phrases, fields and alternatives need the positions of all that match."""
        clauses = fts.parse(query, set(FIELDS), "must" if mode == "and" else "should")
        entry = self.entry()
        if not clauses:
            return self.live("postings", entry).select("id", F.lit(0.0).alias("score")).limit(0)
        post = self.live("postings", entry)
        if all(c.occur == "must" and c.field is None and len(c.terms) == 1 for c in clauses) and len({c.terms for c in clauses}) == len(clauses):
            terms = [c.terms[0] for c in clauses]
            # a block's ids may lie in several segments
            own = self.live("blocks", entry).where(F.col("term").isin(terms))
            blocks = own.groupBy("field", "term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
            live = post.where(F.col("term").isin(terms)).groupBy("field", "term", "block").agg(F.count("*").alias("n"))
            df = block_max.frequencies(live, terms) if entry["tombstones"] else None
            totals = {f: (n, total / n if n else 0.0) for f, (n, total) in entry["totals"].items()}
            return block_max.top_k(post, blocks, totals, terms, limit, df)[0]
        return fts.matches(post, None, clauses, self.totals(entry)).orderBy(F.desc("score"), "id").limit(limit)


def search(
    indexes: dict[str, Index],
    query: str,
    max_results: int = 10,
    mode: str = "hybrid",
    rrf_k: float = ranking.RRF_K,
    rerank: bool = False,
    rerank_top: int = 50,
    path_prefix: str | None = None,
    prefilter: bool = False,
    per_file: int = 0,
    scorer=None,
) -> DataFrame:
    """Search of several indexes (name to Index): hybrid or vector-only, best chunks first.

    Order of steps: lists, fusion, best rows of each index, fetch, union, one row a place, rerank, path
    filter, limit, cap by file.  prefilter puts the path filter before the limits.
    """
    spark = next(iter(indexes.values())).spark
    alpha = T.ALPHA[spark.createDataFrame([(query,)], "q string").select(T.classify_query("q")).first()[0]] if mode == "hybrid" else None
    parts = []
    for name, index in indexes.items():
        chunks = index.read("chunks")
        if chunks is None:
            continue
        hybrid = mode == "hybrid" and index.has_keywords()
        limit = RETRIEVE if mode == "hybrid" else max_results
        near = ranking.ranked(index.vector_hits(query, limit), "vector_rank", limit)
        if hybrid:
            fused = ranking.weighted_rrf(near, ranking.ranked(index.keyword_hits(query, limit), "keyword_rank", limit), alpha, rrf_k)
        else:
            fused = ranking.vector_only(near)
        if prefilter and path_prefix:
            fused = fused.join(ranking.path_prefix(chunks, path_prefix).select(F.col("chunk_id").alias("id")), "id", "left_semi")
        top = fused.orderBy(F.desc("score"), "id").limit(rerank_top if rerank else max_results)
        top = spark.createDataFrame(top.collect(), top.schema)  # rerank_top or max_results rows
        # by their ids only their row groups are read
        shown = chunks.where(F.col("chunk_id").isin([r.id for r in top.select("id").collect()])).withColumnRenamed("chunk_id", "id")
        parts.append(shown.join(F.broadcast(top), "id").withColumn("db", F.lit(name)))
    if not parts:
        raise ValueError("no index to search")
    rows = ranking.dedup_best(reduce(DataFrame.unionByName, parts), ["path", "start_line", "end_line"], "score", "id")
    if rerank:
        raw = (scorer or embedding.lexical_scorer(query))(F.col("content"))
        rows = ranking.blend(rows.withColumn("raw", raw)).withColumn("score", F.col("blended")).drop("raw", "blended")
    if path_prefix:
        rows = ranking.path_prefix(rows, path_prefix)
    rows = rows.orderBy(F.desc("score"), "id").limit(max_results)
    if 0 < per_file < max_results:
        rows = ranking.per_file_cap(rows, per_file).orderBy(F.desc("file_score"), "path", F.desc("score"), "id")
    return rows


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, keys without a value left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
