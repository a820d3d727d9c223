import random
import re

from lodeseek.llm import host_quality as H

SCHEMA = "doc_id long, text string, source string, n_words int"


def expected(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def rows():
    rng = random.Random(1)
    words = ["aa", "é#", "c", "日本", "x|y", "dd"]
    out = [(0, None, "h0", 1), (1, "", None, 1), (2, " \n\t\x0b \n", "h0", 1)]
    for i in range(3, 120):
        own = [rng.choice([" ", "  ", "\n", "\t"]).join(rng.choices(words, k=rng.randint(0, 30)))]
        if rng.random() < 0.5:
            own *= rng.randint(1, 4)
        own.append(rng.choice(["", "tail line", "\n\n tail line\ntail line"]))
        out.append((i, "\n".join(own), rng.choice(["h1", "h2", "h3", None]), 1))
    return out + [out[7]]


def test_counts_equal_brute_force(spark):
    data = rows()
    got = sorted(tuple(r)[:1] + tuple(r)[2:8] for r in H.judge(spark.createDataFrame(data, SCHEMA)).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted((i, *expected(t)) for i, t, _, _ in data)


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    data = [(i, good, "good", 0) for i in range(50)] + [(100 + i, "few", "bad", 0) for i in range(45)] + [(200 + i, good, "bad", 0) for i in range(5)]
    data += [(300, good, "small", 0), (301, "few", "small", 0)] + [(400 + i, good, f"g{i % 4}", 0) for i in range(80)]
    got = {r.doc_id: r for r in H.judge(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not any(got[200 + i].kept for i in range(5)) and got[300].kept and not got[301].kept
    assert all(got[i].kept for i in range(50))
    assert got[0].host_rate < got[300].host_rate < 0.5 < got[200].host_rate


def test_empty_table(spark):
    assert H.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_twin(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text", "source", "n"]))
    theirs = sorted(con.execute(f"SELECT doc_id, n_words, n_repeat_words, base_failed, host_rate, kept FROM ({H.SQL})").fetchall())
    ours = sorted(tuple(r) for r in H.judge(spark.createDataFrame(rows(), SCHEMA)).select("doc_id", "n_words", "n_repeat_words", "base_failed", "host_rate", "kept").collect())
    assert ours == theirs


def test_priors_equal_brute_force(spark):
    rng = random.Random(3)
    good = " ".join(f"w{i}" for i in range(40))
    data, n = [], 0
    for host in range(30):
        share = rng.choice([0.05, 0.1, 0.7])
        for _ in range(rng.randint(1, 40)):
            text = "few words" if rng.random() < share else good + (" #######################################" * 2 if rng.random() < 0.3 else "")
            data.append((n, text, f"h{host}", 0))
            n += 1
    hosts = {}
    for _, text, host, _ in data:
        hosts.setdefault(host, []).append((text == "few words", "###" in text))
    want = {}
    for k, rule in enumerate(("few_words", "symbols")):
        total = sum(map(len, hosts.values()))
        mean = sum(x[k] for v in hosts.values() for x in v) / total
        spread = sum(len(v) * (sum(x[k] for x in v) / len(v) - mean) ** 2 for v in hosts.values()) / total
        between = spread - mean * (1 - mean) * len(hosts) / total
        weight = max(mean * (1 - mean) / between - 1, H.LEAST_STRENGTH) if between > 0 else None
        for host, v in hosts.items():
            want[host, rule] = mean if weight is None else (sum(x[k] for x in v) + mean * weight) / (len(v) + weight)
    got = H.host_rates(H.counts(spark.createDataFrame(data, SCHEMA))).collect()
    assert len(got) == len(hosts)
    for r in got:
        for rule in ("few_words", "symbols"):
            assert abs(r[f"{rule}_rate"] - want[r.source, rule]) < 1e-9
        assert r.host_rate == max(r[f"{rule}_rate"] for rule in H.RULES)
    # hosts that do not differ have the rate of the whole
    assert len({want[h, "few_words"] for h in hosts}) > 10
    alike = H.host_rates(H.counts(spark.createDataFrame([(i, good if i % 5 else "few", f"h{i // 10}", 0) for i in range(100)], SCHEMA))).collect()
    assert {round(r.few_words_rate, 9) for r in alike} == {0.2}
