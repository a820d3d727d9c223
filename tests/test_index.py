import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodeseek import config as C
from lodeseek.operators import embedding
from lodeseek.plans import cli, service
from lodeseek.plans.index import Index, as_json, search
from lodeseek.streaming import watch as W

FILES = {
    "src/parser.py": 'class Parser:\n    """Parses tokens."""\n\n    def parse_tokens(self, text):\n        return text.split()\n',
    "src/store.rs": "/// Saves rows.\npub fn save_rows(n: u32) -> u32 {\n    n\n}\n",
    "docs/guide.md": "# Guide\nHow the parser reads tokens.\n",
    "models/orders.sql": "select * from {{ ref('raw') }}\n",
    "node_modules/x.js": "function hidden() {}\n",
    "skip/a.py": "x = 1\n",
    ".gitignore": "skip/\n",
    "data.bin": "zz",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    (tmp_path / "tree/bad.py").write_bytes(b"\xff\xfe x = 1 # \xe9")
    return tmp_path


def names(rows):
    return sorted({r.path.split("/tree/")[1] for r in rows.select("path").collect()})


def test_index_search_and_increments(spark, root):
    tree, index = str(root / "tree"), Index(spark, str(root / "db"), embedding.HashingArrowEmbedder(64))
    index.index(tree)
    assert names(index.read("chunks")) == ["docs/guide.md", "models/orders.sql", "src/parser.py", "src/store.rs"]
    kinds = {(r.kind, r.signature) for r in index.read("chunks").collect()}
    assert ("Class", "class Parser") in kinds and ("Function", "fn save_rows(n: u32) -> u32") in kinds
    top = search({"local": index}, "parse_tokens", 3).collect()
    assert top[0].path.endswith("parser.py") and top[0].keyword_rank == 1
    assert search({"local": index}, "save rows", 5, rerank=True).first().path.endswith("store.rs")
    assert names(search({"a": index, "b": index}, "parser", 10, path_prefix=tree + "/docs")) == ["docs/guide.md"]
    assert "signature" not in json.loads(as_json(search({"local": index}, "Guide", 1)).first().value)
    first, before = index.version, {r.chunk_id for r in index.read("chunks").collect()}
    index.index(tree)
    assert index.version == first  # nothing changed

    (root / "tree/src/store.rs").write_text("pub fn load_rows() {}\n")
    (root / "tree/docs/guide.md").unlink()
    (root / "tree/new.go").write_text("package p\nfunc Fresh() {\n}\n")
    status = {r.path.split("/tree/")[1]: r.status for r in index.index(tree, dry_run=True).collect()}
    assert {k: v for k, v in status.items() if v != "unchanged"} == {"src/store.rs": "changed", "docs/guide.md": "deleted", "new.go": "new"}
    index.index(tree)
    assert names(index.read("chunks")) == ["models/orders.sql", "new.go", "src/parser.py", "src/store.rs"]
    fresh = index.read("chunks").where(F.col("path").endswith("new.go")).collect()
    assert fresh and not {r.chunk_id for r in fresh} & before
    assert index.keyword_hits("load_rows", 5).count() == 1 and index.keyword_hits("save_rows", 5).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        Index(spark, str(root / "db"), embedding.HashingArrowEmbedder(32)).index(tree)

    # services over the same index
    assert service.index_status({"local": index})["total_files"] == 4
    assert service.semantic_search({"local": index}, "parse", 2) and service.get_file_chunks({"local": index}, tree + "/new.go")
    server = service.serve({"local": index})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(url + "/health")) == {"status": "ready"}
    body = json.dumps({"query": "parse tokens", "limit": 2}).encode()
    assert len(json.load(urllib.request.urlopen(urllib.request.Request(url + "/search", body)))["results"]) == 2
    server.shutdown()


def test_change_records(spark, root):
    tree, index = str(root / "tree"), Index(spark, str(root / "db"), embedding.HashingArrowEmbedder(16))
    index.index(tree)
    (root / "tree/src/store.rs").rename(root / "tree/src/moved.rs")
    (root / "tree/docs/guide.md").unlink()
    rows = [(1, "renamed", f"{tree}/src/store.rs", f"{tree}/src/moved.rs"), (2, "removed", f"{tree}/docs/guide.md", None), (3, "created", f"{tree}/Cargo.lock", None), (4, "modified", f"{tree}/docs/guide.md", None)]
    (root / "changes").mkdir()
    (root / "changes/1.json").write_text("\n".join(json.dumps(dict(zip(("seq", "op", "path", "new_path"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema(W.CHANGES).json(str(root / "changes"))
    W.watch_records(stream, index, tree, str(root / "checkpoint")).awaitTermination()
    assert names(index.read("chunks")) == ["models/orders.sql", "src/moved.rs", "src/parser.py"]


def test_watch_ignores(spark):
    d = spark.createDataFrame([(p,) for p in (".git/config", "node_modules/foo", "test.dll", "a/test.exe", "Cargo.lock", "src/main.rs")], "path string")
    assert [r.path for r in W.watched(d, []).collect()] == ["src/main.rs"]


def test_config(tmp_path):
    assert C.load(tmp_path / "none.toml").indexing.max_chunk_lines == 75
    (tmp_path / "c.toml").write_text('[embedding]\nmodel = "bge-small"\n[embedding.ollama]\ntimeout = 5\n')
    got = C.load(tmp_path / "c.toml")
    assert got.embedding.model == "bge-small" and got.embedding.ollama.timeout == 5 and got.embedding.provider == "cpu"
    C.save(got, tmp_path / "d.toml")
    assert C.load(tmp_path / "d.toml") == got


def test_registry_and_cli(spark, root, monkeypatch, capsys):
    monkeypatch.setattr(C, "config_path", lambda: root / "home/config.toml")
    tree, db = str(root / "tree"), str(root / "db")
    assert cli.main(["index", tree, "--db", db], spark) == 0
    assert cli.main(["search", "parse_tokens", "--db", db, "--compact"], spark) == 0
    assert "parser.py" in capsys.readouterr().out
    assert cli.main(["list"]) == 0 and db in capsys.readouterr().out
    assert cli.main(["stats", "--db", db], spark) == 0 and "'total_files': 4" in capsys.readouterr().out
    assert cli.main(["clear", "--db", db], spark) == 0 and not service.Registry(str(root / "home/projects.json")).all()
    assert cli.main(["doctor"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["search"])


def test_pointer_size_and_search_without_full_text(spark, root):
    tree, index = str(root / "tree"), Index(spark, str(root / "db2"), embedding.HashingArrowEmbedder(64))
    index.index(tree)
    first = index.version
    gone = index.delete_files(spark.createDataFrame([(f"file:{tree}/docs/guide.md",), (f"{tree}/docs/guide.md",)], "path string"))
    assert gone.count() == 1 and index.version != first
    assert index.size()["bytes"] > 0 and index.size()["bytes_per_chunk"] > 0
    import shutil

    shutil.rmtree(f"{root}/db2/postings")
    assert not index.has_keywords()
    assert search({"local": index}, "save rows", 3).count() == 3


def test_databases_of_a_tree(tmp_path, monkeypatch):
    monkeypatch.setattr(service, "GLOBAL_STORES", str(tmp_path / "stores"))
    tree = tmp_path / "tree"
    assert service.databases(str(tree)) == {}
    (tree / service.LOCAL_NAME).mkdir(parents=True)
    assert list(service.databases(str(tree))) == ["local"]
