import hashlib
import random
import re

import pytest

from lodeseek.llm import pii_boosting as P

SCHEMA = "doc_id long, text string, email string, spans int"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def expected(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, rx) in enumerate(KINDS.items()) for m in re.finditer(rx, text or "") if passes(kind, m[0])]
    spans.sort()
    return [sum(s[3] == k for s in spans) for k in KINDS], ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


@pytest.fixture(scope="module")
def judge(spark):
    return P.train(spark)


def texts():
    rng = random.Random(4)
    parts = ["a@b.co", "x.y+z@m-1.example.com", "@", "a@b.c_d@e.fg", "é@x.y", "日本", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "99999999999999999999.1.1.1", "007.1.1.1", "4337166598464399", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "+1 (632) 555-4827", "+49 30 1234", "++12.34", "5", " ", "\n", ".", "-", "+", "word", "12 34"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)]
    return [None, "", "1" * 30_000, "1-" * 20_000, "a" * 60_000 + "@", "a." * 30_000 + "@b", *out]


def test_base_spans_equal_the_patterns(spark, judge):
    data = texts()
    got = {r.doc_id: r for r in P.find(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(data)], SCHEMA), judge).selectExpr("doc_id", *(f"size({k}) AS {k}" for k in KINDS), "transform(base, c -> concat(c.kind, ':', c.start, ':', c.end)) AS base", "transform(spans, c -> concat(c.kind, ':', c.start, ':', c.end)) AS spans").collect()}
    for i, t in enumerate(data):
        counts, joined = expected(t)
        assert [got[i][k] for k in KINDS] == counts, t
        assert ",".join(got[i].base) == joined, t
        assert set(got[i].base) <= set(got[i].spans)


def test_judged_proposals(spark, judge):
    good = ["call me at (212) 555-0187 today", "SSN: 123-45-6789", "jo (at) mail (dot) org", "IBAN DE89370400440532013000"]
    bad = ["order 1234567890", "the 93551305124 of", "2019-05-12 in", "total 123456789"]
    got = {r.doc_id: r.n for r in P.find(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(good + bad)], SCHEMA), judge).selectExpr("doc_id", "size(spans) AS n").collect()}
    assert all(got[i] >= 1 for i in range(len(good)))
    assert all(got[len(good) + i] == 0 for i in range(len(bad)))


def test_held_out_candidates(spark, judge):
    rows = P.labelled_candidates(spark, 3 * P.CANDIDATES).where(f"id >= {P.CANDIDATES}").selectExpr("id AS doc_id", "text", "label")
    found = P.find(rows, judge).selectExpr("doc_id", "size(spans) > 0 AS hit").join(rows.select("doc_id", "label"), "doc_id").collect()
    hits = [r for r in found if r.hit]
    assert sum(r.label for r in hits) >= 0.9 * len(hits)
    assert len(hits) >= 0.8 * sum(r.label for r in found)


def test_empty_table(spark, judge):
    assert P.find(spark.createDataFrame([], SCHEMA), judge).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_of_overlapping_proposals_one_stays(spark, judge):
    """Held against a greedy choice by probability."""
    rng = random.Random(9)
    parts = ["call 212 555 0187", "jo (at) 2125550187 (dot) org", "IBAN DE89370400440532013000", "a@b.co", "5551234567(at)mail.com", "+1 (632) 555-4827", "x", "SSN 123-45-6789", "DE8937040044053201 3000", "tel 030 1234567(at)b.de"]
    data = [(i, rng.choice([" ", ", ", ""]).join(rng.choices(parts, k=rng.randint(1, 40))), "", 0) for i in range(60)]
    open_ = P.Judge(judge.probability, {k: 0.0 for k in P.ADDED})
    d = P.with_proposals(spark.createDataFrame(data, SCHEMA).select("doc_id", "text"))
    every = {r.doc_id: r.c for r in d.selectExpr("doc_id", f"transform(proposed, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'p', {judge.probability})) AS c").collect()}
    overlaps = 0
    for r in P.find(spark.createDataFrame(data, SCHEMA), open_).collect():
        meet = lambda a, b: a.start < b.end and b.start < a.end
        free = [c for c in every[r.doc_id] if not any(meet(b, c) for b in r.base)]
        kept = []
        for c in sorted(free, key=lambda c: (-c.p, c.start - c.end, P.KINDS.index(c.kind))):
            if not any(meet(k, c) for k in kept):
                kept.append(c)
        overlaps += len(free) - len(kept)
        assert sorted((c.start, c.end, c.kind) for c in kept) == [(c.start, c.end, c.kind) for c in r.spans if c.kind in P.ADDED], r.text
    assert overlaps > 5


def test_probabilities_are_calibrated(spark, judge):
    made = P.written(P.labelled_candidates(spark, 3 * P.CANDIDATES).where(f"id >= {P.CANDIDATES}"), "made")
    rows = P.written(P.with_proposals(made), "proposed").selectExpr("label", "explode(proposed) AS c").selectExpr("label", f"{judge.probability} AS p").collect()
    error = 0
    for low in (0, 0.1, 0.3, 0.5, 0.7, 0.9):
        own = [r for r in rows if low <= r.p < {0: 0.1, 0.1: 0.3, 0.3: 0.5, 0.5: 0.7, 0.7: 0.9, 0.9: 1.01}[low]]
        error += abs(sum(r.label for r in own) - sum(r.p for r in own)) / len(rows)
    assert error < 0.03


def test_very_many_spans_in_one_text(spark, judge):
    text = " ".join(f"a{i}@b.co 1.2.3.{i % 256} tel 030 {1000000 + i}" for i in range(4_000))
    r = P.find(spark.createDataFrame([(1, text, "", 0)], SCHEMA), judge).selectExpr("size(email) AS e", "size(ip) AS i", "size(spans) AS s", "spans[size(spans) - 1].end AS last").first()
    assert r.e == r.i == 4_000 and r.s >= 8_000 and r.last <= len(text)
