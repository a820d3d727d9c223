import math
import random
import re

import pytest

from lodeseek.llm import curriculum as M

SCHEMA = "doc_id long, text string, source string, size string, target int"


def rows_of(n=150, seed=4):
    rng = random.Random(seed)
    sources = ["b", "a", "a", "a", "a", "ß", "é", "z", None, "\U0001f600", "￮", ""]
    out = [(i, rng.choice([" ", "\t\n", "\x0b"]).join(["w"] * rng.randint(0, 40)), rng.choice(sources), "x", 1) for i in range(n)]
    out += [(n, None, "a", None, 1), (n + 1, "", "b", None, 1), (None, "one two", None, None, 1), (n + 2, "v " * 20000, "z", None, 1), (n + 3, None, "nothing", None, 1)]
    return out + [out[5], out[5], (out[6][0], "other text", "a", None, 1)]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, limit=3):
    """Shares by weight; the excess of sources above their limit shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / whole > limit * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s], rest = float(limit * sizes[s]), rest - limit * sizes[s]
        open_ -= over
    return target


def test_targets_and_taken_words(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = M.mix(frame).collect()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = brute_targets(sizes, [1, 2, 3])
    assert sorted((repr(r.doc_id), repr(r.source), r.size, r.source_size) for r in got) == sorted((repr(i), repr(s), words(t), sizes[s]) for i, t, s, *_ in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(x.words for x in r.readings) and all(0 < x.words <= r.size for x in r.readings)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == math.floor(target[s] + 1e-6)
    assert any(target[s] == 3 * sizes[s] > 0 for s in sizes) and any(0 < target[s] < sizes[s] for s in sizes)


def test_reruns_agree_whatever_the_partitions(spark):
    runs = []
    for parts in (1, 7):
        frame = spark.createDataFrame(rows_of(), SCHEMA).repartition(parts)
        runs.append(sorted(repr((r.doc_id, r.source, r.size, r.target, r.taken, [(x["pass"], x.words, x.position) for x in r.readings])) for r in M.mix(frame).collect()))
    assert runs[0] == runs[1]


def test_positions_follow_the_schedules(spark):
    """At any time a source has given what its schedule has integrated to, within a document."""
    rows = [(i, "w " * 20, "abc"[i % 3], "", 0) for i in range(900)]
    knots = ((4.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.0, 0.0, 4.0))
    mixed = M.mix(spark.createDataFrame(rows, SCHEMA), knots)
    order = M.training_order(mixed).collect()
    source = {i: s for i, _, s, *_ in rows}
    target = {r.source: r.target for r in mixed.collect()}
    given = dict.fromkeys("abc", 0)
    assert [r.position for r in order] == sorted(r.position for r in order)
    integral = {"a": lambda t: 1 - (1 - 2 * min(t, 0.5)) ** 2, "b": lambda t: t, "c": lambda t: (2 * max(t, 0.5) - 1) ** 2}
    for r in order:
        at = sum(given.values())
        assert abs(r.position - at) <= 3 * 21
        for s, f in integral.items():
            assert abs(given[s] - target[s] * f(r.time)) <= 21
        given[source[r.doc_id]] += r.words
    assert abs(sum(given.values()) - 900 * 20) <= 3


@pytest.mark.parametrize("bad", [((1.0,),), ((1.0, 2.0), (1.0, 2.0, 3.0)), ((0.0, 0.0),), ((-1.0, 2.0),)])
def test_bad_schedules(spark, bad):
    with pytest.raises(ValueError):
        M.mix(spark.createDataFrame([], SCHEMA), bad)


def test_empty_tables(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = M.mix(spark.createDataFrame([(1, None, None, "", 0), (2, " \n", "a", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken, len(r.readings)) for r in got) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_sql_twin(spark, tmp_path):
    import duckdb
    import pandas as pd

    rows = rows_of(400)
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    names = ["doc_id", "size", "source_size", "target", "taken", "n_readings", "first_time"]
    ours = M.op13_curriculum_mix(spark, str(tmp_path)).select(*names).collect()
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({M.SQL})").fetchall()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, theirs))
