"""What callers outside Spark use: tool functions, a small HTTP server, a registry of projects."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking
from .index import Index, search

SEARCH_LIMIT, TOOL_LIMIT, SNIPPET_BYTES = 25, 10, 200


class Registry:
    """Projects and the databases they have, in a JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def _put(self, projects: dict[str, str]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(projects, indent=1, sort_keys=True))

    def save(self, project: str, database: str) -> None:
        self._put(self.all() | {project: database})

    def find(self, part: str) -> dict[str, str]:
        return {p: d for p, d in self.all().items() if part in p}

    def remove(self, part: str) -> int:
        gone = self.find(part)
        self._put({p: d for p, d in self.all().items() if p not in gone})
        return len(gone)

    def cleanup(self, database: str) -> int:
        kept = {p: d for p, d in self.all().items() if d != database}
        n = len(self.all()) - len(kept)
        self._put(kept)
        return n


def semantic_search(indexes: dict[str, Index], query: str, limit: int = TOOL_LIMIT) -> list[dict]:
    rows = search(indexes, query, limit, mode="vector")
    return [r.asDict(recursive=True) for r in rows.select("path", "start_line", "end_line", "kind", "content", "signature", "score", "db").collect()]


def get_file_chunks(indexes: dict[str, Index], path: str) -> list[dict]:
    out = []
    for name, index in indexes.items():
        if index.version:
            out += [r.asDict(recursive=True) | {"db": name} for r in index.file_chunks(path).drop("embedding").collect()]
    return out


def index_status(indexes: dict[str, Index]) -> dict:
    each = {name: index.stats() for name, index in indexes.items()}
    return {"databases": each, "total_chunks": sum(s["total_chunks"] for s in each.values()), "total_files": sum(s["total_files"] for s in each.values()), "indexed": any(s["indexed"] for s in each.values())}


def http_search(indexes: dict[str, Index], body: dict) -> dict:
    """Vector search; the path filter comes after the limit; content is cut short."""
    rows = search(indexes, body["query"], int(body.get("limit", SEARCH_LIMIT)), mode="vector")
    if body.get("path"):
        rows = ranking.path_contains(rows, body["path"])
    rows = rows.select("path", "start_line", "end_line", "kind", T.truncated(F.col("content"), SNIPPET_BYTES).alias("content"), "score", "db")
    return {"results": [r.asDict() for r in rows.collect()]}


def serve(indexes: dict[str, Index], port: int = 0) -> ThreadingHTTPServer:
    """A server on 127.0.0.1: GET /health, GET /status, POST /search.  The caller runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, value) -> None:
            data = json.dumps(value, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            if self.path == "/health":
                self._send(200, {"status": "ready"})
            elif self.path == "/status":
                self._send(200, index_status(indexes))
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self):  # noqa: N802
            if self.path != "/search":
                return self._send(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self._send(200, http_search(indexes, body))
            except (KeyError, ValueError) as e:
                self._send(400, {"error": str(e)})

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


#: Name of a database within a tree, and the place of databases outside of trees.
LOCAL_NAME, GLOBAL_STORES = ".lodeseek.db", "~/.lodeseek/stores"


def databases(root: str) -> dict[str, str]:
    """The places of a tree's databases that exist: the local one, then the global one."""
    import hashlib
    import os

    root = os.path.realpath(root)
    places = {"local": os.path.join(root, LOCAL_NAME), "global": os.path.join(os.path.expanduser(GLOBAL_STORES), hashlib.sha256(root.encode()).hexdigest())}
    return {name: place for name, place in places.items() if os.path.isdir(place)}
