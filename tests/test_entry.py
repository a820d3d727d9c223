import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as E

    rows = E.entry(spark)
    assert rows.columns == ["id", "score", "path", "kind"] and rows.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["vector_topk_batch", "fts_bm25_multifield", "weighted_rrf", "rerank_blend", "classify_query", "split_oversized", "gap_chunks", "string_literals", "change_detect", "chunk_ids", "ann_search", "segment_search", "ignore_rules", "binary_content", "chunk_sizes", "hydrate", "event_debounce", "cache_eviction", "token_batches", "token_budget", "dbt_refs"])
def test_sql_twins(spark, name):
    import duckdb

    from lodeseek.plans import catalog

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = catalog.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    ours = sorted(repr([tuple(v) if isinstance(v, list) else v for v in (r[c] for c in cols)]) for r in frame.collect())
    got = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert ours == sorted(repr([tuple(v) if isinstance(v, list) else v for v in r]) for r in got)


def test_imports_without_the_subpackage(tmp_path):
    """The entry point and the engine stand without the training-data folders and the pipeline."""
    import shutil

    shutil.copytree(f"{ROOT}/lodeseek", tmp_path / "lodeseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'hybrid_search' in n and not any(x.startswith('op') for x in n), n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
