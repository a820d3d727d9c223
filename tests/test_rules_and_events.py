"""Ignore rules of every folder, bursts of events, running sums, token batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import changes, embedding, events
from lodeseek.operators.running import with_running_sum
from lodeseek.sources import files as S
from lodeseek.sources import ignore, listing
from lodeseek.streaming import watch as W

TREE = {
    ".gitignore": "*.log\n!keep.log\nbuild/\n/only_root.py\ndocs/*\n!docs/read.md\n",
    "a.py": "a", "only_root.py": "x", "sub/only_root.py": "y", "__init__.py": "", "sub/__init__.py": "i",
    "sub/.gitignore": "!b.log\n*.md\n\\#odd.py\n",
    "sub/b.py": "b", "sub/c.md": "c", "sub/#odd.py": "o", "sub/deep/.lodeseekignore": "secret.*\n", "sub/deep/secret.py": "s", "sub/deep/open.py": "p",
    "build/x.py": "x", "build/.gitignore": "!x.py\n", "docs/read.md": "r", "docs/other.md": "o", "docs/in/read.md": "q",
    "excluded.py": "e", "global.py": "g", "sub/global.py": "g", ".hidden.py": "h", ".dot/in.py": "h", "node_modules/z.py": "z",
}
KEPT = {"a.py", "sub/only_root.py", "__init__.py", "sub/__init__.py", "sub/b.py", "sub/deep/open.py", "docs/read.md", "sub/global.py"}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    (tmp_path / "tree/.git/info").mkdir(parents=True)
    (tmp_path / "tree/.git/info/exclude").write_text("excluded.py\nglobal.py\n")
    (tmp_path / "global").write_text("global.py\n!global.py\n")
    (tmp_path / "tree/sub/.gitignore").write_text("!b.log\n*.md\n\\#odd.py\n!global.py\n")
    return tmp_path / "tree"


def test_rules_of_every_folder(spark, tree):
    walked = S.walk(spark, str(tree), global_file=str(tree.parent / "global"))
    assert {r.relative for r in walked.select("relative").collect()} == KEPT
    hidden = S.walk(spark, str(tree), include_hidden=True)
    assert {r.relative for r in hidden.select("relative").collect()} == KEPT | {".hidden.py", ".dot/in.py"}
    assert {r.relative: bytes(r.content) for r in hidden.where("relative IN ('.hidden.py', 'a.py')").select("relative", "content").collect()} == {".hidden.py": b"h", "a.py": b"a"}
    every = {r.relative for r in S.walk(spark, str(tree), respect_ignore=False).select("relative").collect()}
    assert {"sub/c.md", "only_root.py", "docs/other.md"} < every and not any(x.startswith(("node_modules", ".hidden", "build")) for x in every)


def test_the_last_rule_wins_and_parents_come_first(spark):
    rules = spark.createDataFrame(
        [("", -2, 0, "*.tmp"), ("", -1, 0, "!a.tmp"), ("", 0, 0, "x/"), ("", 0, 1, "!x/in.py"), ("y", 1, 0, "*"), ("y", 1, 1, "!*.py"), ("y", 1, 2, ""), ("y", 1, 3, "# c"), ("y", 1, 4, None), ("", 0, 2, "/")],
        ignore.RULES,
    )
    paths = spark.createDataFrame([(p,) for p in ["a.tmp", "b.tmp", "x/in.py", "x", "y/a.py", "y/a.md", "y/z/a.py", "z/y/a.md", "", "a.tmp"]], "relative string")
    assert sorted(r.relative for r in ignore.ignored_paths(paths, rules).collect()) == ["b.tmp", "x/in.py", "y/a.md", "y/z/a.py"]
    assert ignore.ignored_paths(paths, rules.limit(0)).count() == 0 and ignore.ignored_paths(paths.limit(0), rules).count() == 0


def test_rules_above_some_paths(spark, tree):
    paths = spark.createDataFrame([("sub/deep/secret.py",), ("a.py",), ("gone/x.py",)], "relative string")
    rules = ignore.rules_above(spark, str(tree), paths)
    assert {r.folder for r in rules.collect()} == {"", "sub", "sub/deep"}
    assert [r.relative for r in ignore.ignored_paths(paths, rules).collect()] == ["sub/deep/secret.py"]


def test_listing_sees_hidden_names(spark, tree):
    found = {r.relative: r for r in listing.listed(spark, str(tree)).collect()}
    assert {".gitignore", ".hidden.py", ".dot", ".dot/in.py", "__init__.py", "sub/deep/.lodeseekignore"} <= set(found)
    assert found[".dot"].is_dir and found["a.py"].size == 1 and not any(x.startswith(("node_modules", ".git/")) for x in found)


START = datetime(2024, 1, 1)


def bursts(rows, gap):
    """Bursts by going through each key's events in order."""
    out, last = [], {}
    for key, second, i in sorted(rows):
        if key in last and second <= last[key][3] + gap:
            last[key][2] += 1
            last[key][3] = second
        else:
            last[key] = [key, i, 1, second]
            out.append(last[key])
    return sorted((k, i, n) for k, i, n, _ in out)


def test_bursts_of_a_table(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 600), i) for i in range(150)] + [("c", 10, 900), ("c", 20, 901), ("c", 30, 902)]
    frame = spark.createDataFrame([(k, START + timedelta(seconds=s), i, f"e{i}") for k, s, i in rows], "key string, ts timestamp, i int, name string")
    got = events.debounced(frame, ["key"], "ts", "i", "10 seconds").collect()
    assert sorted((r.key, r.i, r.n) for r in got) == bursts(rows, 10) and all(r.name == f"e{r.i}" for r in got)
    assert events.debounced(frame.limit(0), ["key"], "ts", "i", "10 seconds").collect() == []


def test_bursts_across_ranges(spark):
    """A crowded key over several ranges, equal times, null keys and times."""
    rng = random.Random(5)
    rows = [("a", 10 * rng.randint(0, 400) + rng.choice([0, 0, 3]), i) for i in range(600)] + [("b", 5, 700), ("b", 5, 701), ("c", 1, 702)]
    odd = [(None, START, 800, "e800"), (None, START + timedelta(seconds=4), 801, "e801"), ("c", None, 802, "e802")]
    frame = spark.createDataFrame([(k, START + timedelta(seconds=s), i, f"e{i}") for k, s, i in rows] + odd, "key string, ts timestamp, i int, name string").repartition(5)
    got = events.bursts(frame, ["key"], "ts", "i", "10 seconds").collect()
    assert sorted((r.key, r.i, r.n) for r in got if r.key) == bursts(rows, 10) and all(r.name == f"e{r.i}" for r in got)
    assert [(r.i, r.n) for r in got if r.key is None] == [(800, 2)]
    plain = sorted(map(repr, events.debounced(frame, ["key"], "ts", "i", "10 seconds").collect()))
    assert sorted(map(repr, got)) == plain
    assert events.bursts(frame.limit(0), ["key"], "ts", "i", "10 seconds").collect() == []


def test_settled_stream_with_late_rows(spark, tmp_path):
    """The first change of a burst is emitted once its path is quiet; what comes behind the watermark is not."""
    import json

    (tmp_path / "in").mkdir()
    at = lambda s: (START + timedelta(seconds=s)).isoformat()
    batches = [
        [(1, "created", "a", at(0)), (2, "modified", "a", at(2)), (3, "modified", "b", at(1))],
        [(4, "removed", "a", at(4)), (5, "modified", "c", at(60))],
        [(6, "modified", "b", at(3)), (7, "modified", "d", at(120))],  # b at 3 is later than the watermark
        [(8, "modified", "e", at(300))],
    ]
    schema = W.CHANGES + ", ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for k, rows in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "op", "path", "ts"), r))) for r in rows))
        import os

        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    out = W.settled(stream, "5 seconds", "5 seconds")
    q = out.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.path, r.seq, r.op) for r in spark.table("settled").collect())
    assert got[:4] == [("a", 1, "created"), ("b", 3, "modified"), ("c", 5, "modified"), ("d", 7, "modified")] and len(got) in (4, 5)


def test_running_sums_over_crowded_and_equal_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, 5]), rng.choice([None, 1, 2, 10**12]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, v long, i int").repartition(7)
    got = {r.i: r.before for r in with_running_sum(frame, ["k", "i"], "v").collect()}
    total = 0
    for k, v, i in sorted(rows, key=lambda r: (r[0], r[2])):
        assert got[i] == total
        total += v or 0
    ties = sorted(r.before for r in with_running_sum(frame.withColumn("one", F.lit(1)), ["k"], "one").collect())
    assert ties == list(range(500))
    assert with_running_sum(frame.limit(0), ["k"], "v").collect() == []


@pytest.mark.parametrize("budget", [7, 40, 1000])
def test_batches_do_not_depend_on_partitions(spark, budget):
    rng = random.Random(budget)
    rows = [(i, "x" * rng.choice([0, 1, 3, 4, 9, 30, 30, 30, 200, 5000])) for i in range(300)] + [(300, None)]
    n = k = 0
    expected = {}
    for i, t in sorted(rows, key=lambda r: (len(r[1] or ""), r[0])):
        tokens = -(-len(t or "") // 4)
        if n and tokens * (n + 1) > budget:
            n, k = 0, k + 1
        n, expected[i] = n + 1, k
    for parts in (1, 6):
        frame = spark.createDataFrame(rows, "i int, t string").repartition(parts)
        assert {r.i: r.batch for r in embedding.budget_batches(frame, "t", budget, "i").collect()} == expected
    assert embedding.budget_batches(frame.limit(0), "t", budget, "i").collect() == []


def test_within_budget(spark):
    rows = [("a", 5, 10), ("b", 5, 10), ("c", 9, 10), ("d", None, 1), ("e", 1, None)]
    frame = spark.createDataFrame(rows, "key string, used int, bytes int")
    kept = lambda budget: sorted(r.key for r in changes.within_budget(frame, "used", "bytes", "key", budget).collect())
    assert kept(30) == ["a", "b", "c", "e"] and kept(31) == ["a", "b", "c", "d", "e"] and kept(25) == ["a", "c"] and kept(0) == []
