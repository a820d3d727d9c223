"""Command line: ``python -m lodeseek.plans.cli index|search|list|stats|clear|serve|doctor``."""

from __future__ import annotations

import argparse
import importlib.util
import sys

from .. import config as C
from ..operators import embedding, ranking
from ..operators.embedding_cache import EmbeddingCache
from .index import Index, as_json, search
from .service import Registry, databases, serve


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeseek")
    p.add_argument("--model")
    p.add_argument("--backend", choices=sorted(embedding.BACKENDS))
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("path")
    one.add_argument("--db")
    one.add_argument("--force", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one = sub.add_parser("search")
    one.add_argument("query")
    one.add_argument("--db", action="append", help="else those of the current directory, local and global")
    one.add_argument("-m", "--max-results", type=int, default=10)
    one.add_argument("--per-file", type=int, default=0)
    one.add_argument("--path")
    one.add_argument("--rrf-k", type=float, default=ranking.RRF_K)
    one.add_argument("--rerank", action="store_true")
    one.add_argument("--rerank-top", type=int, default=50)
    one.add_argument("--vector-only", action="store_true")
    one.add_argument("--sync")
    one.add_argument("--json", action="store_true")
    one.add_argument("--compact", action="store_true")
    for name in ("stats", "clear"):
        sub.add_parser(name).add_argument("--db", action="append", help="else those of the current directory")
    one = sub.add_parser("serve")
    one.add_argument("--db", action="append", help="else those of the current directory")
    one.add_argument("--port", type=int, default=4444)
    sub.add_parser("list")
    sub.add_parser("doctor")
    return p


def doctor() -> dict[str, bool]:
    return {name: importlib.util.find_spec(name) is not None for name in ("pyspark", "pyarrow", "numpy", "pandas", "onnxruntime")}


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    registry = Registry(str(C.config_path().parent / "projects.json"))
    if a.command == "doctor":
        for name, ok in doctor().items():
            print(f"{'ok' if ok else 'missing'}  {name}")
        return 0
    if a.command == "list":
        for project, db in registry.all().items():
            print(f"{project}\t{db}")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodeseek").getOrCreate()
    settings = C.load(a.config)
    model = embedding.model(a.model or settings.embedding.model or embedding.DEFAULT_MODEL)
    backend = embedding.BACKENDS[a.backend or settings.embedding.backend]
    embedder = embedding.HttpEmbedder(settings.embedding.ollama.url, settings.embedding.ollama.model, model.dimensions) if backend == "http" else embedding.HashingArrowEmbedder(model.dimensions)
    # a service is asked once for each text; hashing costs less than a look into a cache
    cache = EmbeddingCache(spark, str(C.config_path().parent / f"embeddings-{embedder.model_name}")) if backend == "http" else None
    at = lambda db: Index(spark, db, embedder, model.short, cache)

    def chosen() -> dict[str, str]:
        found = {f"db{k}" if k else "local": db for k, db in enumerate(a.db)} if a.db else databases(".")
        if not found:
            raise SystemExit("no database here; index first, or name one with --db")
        return found

    if a.command == "index":
        index = at(a.db or f"{a.path.rstrip('/')}/.lodeseek.db")
        status = index.index(a.path, full=a.force, dry_run=a.dry_run)
        if a.dry_run:
            for r in status.orderBy("path").toLocalIterator():
                print(r.status, r.path)
        else:
            registry.save(a.path, index.root)
    elif a.command == "search":
        indexes = {name: at(db) for name, db in chosen().items()}
        if a.sync:
            next(iter(indexes.values())).index(a.sync)
        rows = search(indexes, a.query, a.max_results, "vector" if a.vector_only else "hybrid", a.rrf_k, a.rerank, a.rerank_top, a.path, per_file=0 if a.json or a.compact else a.per_file)
        if a.json:
            print("\n".join(r.value for r in as_json(rows).collect()))
        elif a.compact:
            print("\n".join(dict.fromkeys(r.path for r in rows.select("path").collect())))
        else:
            for r in rows.collect():
                print(f"{r.path}:{r.start_line + 1}-{r.end_line}  {r.kind}  {r.score:.4f}")
    elif a.command == "stats":
        for name, db in chosen().items():
            print(name, at(db).stats())
    elif a.command == "clear":
        for db in chosen().values():
            at(db).clear()
            registry.cleanup(db)
    elif a.command == "serve":
        serve({name: at(db) for name, db in chosen().items()}, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
