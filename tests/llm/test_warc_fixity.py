from lodeseek.llm import warc_fixity as W

SCHEMA = "page_id long, url string, html string, hash string"


def test_only_the_damaged_records(spark):
    rows = [(i, f"http://h/{i}", f"<p>éé {i}</p>" * (i % 7), "x") for i in range(0, 9000, 3)] + [(None, "u", None, "x"), (6, None, None, "x"), (6, None, None, "x"), (-3, "n", "", "x"), (70_000, "far", "", "x")]
    bad = {300: ("same length", "<q>"), 4098: ("longer", "<p>longer than before</p>")}
    other = [(i, u, bad[i][1] if i in bad else h, x) for i, u, h, x in reversed(rows) if i != 303] + [(1, "new", "", "x")]
    a, b = (W.records(spark.createDataFrame(r, SCHEMA)) for r in (rows, other))
    found = {r.number: r for r in W.audit(a, b).collect()}
    assert {n: r.status for n, r in found.items()} == {300: "changed", 4098: "changed", 303: "missing", 1: "extra"}
    assert W.audit(a, a).collect() == []
    # offsets within the primary's archive
    sizes = {}
    for r in a.collect():
        sizes[r.number] = sizes.get(r.number, 0) + len(r.record.encode())
    for n in (300, 4098, 303):
        start = sum(s for k, s in sizes.items() if n // W.SLOTS * W.SLOTS <= k < n)
        assert (found[n].start, found[n].end) == (start, start + sizes[n])
    assert found[1].start is None


def test_one_fault_opens_one_branch(spark):
    rows = [(i, "u", "abc", "x") for i in range(5000)]
    a = W.records(spark.createDataFrame(rows, SCHEMA))
    b = W.records(spark.createDataFrame([(i, u, "a longer one" if i == 7 else h, x) for i, u, h, x in rows], SCHEMA))
    tree = W.levels(a, b)
    for level in tree:
        differ = level.groupBy("node").agg({"hash": "min", "bytes": "count"}).join(level, "node").where("`min(hash)` <> hash").select("node").distinct().collect()
        assert [r.node for r in differ] == [0]
    assert tree[-1].where("side = 0").count() == 1


def test_rows_of_one_number_in_any_order(spark):
    rows = [(None, "u", str(i), "x") for i in range(50)] + [(3, "a", "1", "x"), (3, "b", "2", "x")]
    a, b = (W.records(spark.createDataFrame(r, SCHEMA)) for r in (rows, rows[::-1]))
    assert W.audit(a, b).collect() == []
    changed = W.records(spark.createDataFrame([(None, "u", "changed", "x"), *rows[1:]], SCHEMA))
    assert [(r.number, r.status) for r in W.audit(a, changed).collect()] == [(W.NO_NUMBER, "changed")]


def test_empty_tables(spark):
    none = W.records(spark.createDataFrame([], SCHEMA))
    one = W.records(spark.createDataFrame([(0, "u", "abc", "x")], SCHEMA))
    assert W.audit(none, none).collect() == []
    assert [(r.number, r.status) for r in W.audit(one, none).collect()] == [(0, "missing")]
