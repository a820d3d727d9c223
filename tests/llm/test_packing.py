import random
import zlib

import numpy as np
import pytest

from lodeseek.llm import packing as P

SCHEMA = "doc_id long, text string, piece int"


def test_encoding_equals_tokenizers():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.tokenizer_path())  # as the contract calls it
    texts = ["", " ", "It's  the\n\n end 12 345's!?", "<|endoftext|> x", "naïve café ñandú 東京 🎉  x", "a" * 3000, "tab\t\tx ", "don'T we'll", "x" + " " * 9_999 + "y", "x" + " \n" * 6_000 + "y <|endoftext|>", "\u00a0" * 10_001 + "é"]
    for t in texts:
        assert P.encode_text(t, P.tokenizer_path()) == reference.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "7", "\u3000", " \t"])
def test_very_long_texts_of_one_kind(unit):
    ids = P.encode_text(unit * 2_500_000, P.tokenizer_path())
    assert P.slow_encoding(P.tokenizer_path()).decode(ids, skip_special_tokens=False) == unit * 2_500_000


def test_long_white_space_in_the_query(spark):
    from tokenizers import Tokenizer

    texts = ["a" + " " * 1_500_000 + "b", "\n" * 1_200_000]
    got = P.placed(P.pack(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA))).groupBy("doc_id").agg({"length": "sum"}).collect()
    reference = Tokenizer.from_file(P.tokenizer_path())
    assert {r[0]: r[1] for r in got} == {i: len(reference.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_best_fit_fills_and_keeps_all():
    rng = random.Random(1)
    for cap in (10, 64):
        sizes = [rng.randint(1, cap) for _ in range(300)]
        bins = P.best_fit(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(300))
        fills = [sum(sizes[i] for i in b) for b in bins]
        assert max(fills) <= cap and sum(f <= cap // 2 for f in fills) <= 1


@pytest.mark.parametrize("parts,capacity,partners", [(1, 2048, 2), (6, 40, 2), (6, 40, None)])
def test_round_trip(spark, parts, capacity, partners):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [None, "", "x"] + [" ".join(rng.choices(["alpha", "beta", "été", "7"], k=rng.randint(0, 90))) for _ in range(120)]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(5, texts[5], 3)]
    seqs = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(parts), capacity=capacity, partners=partners)
    got = P.placed(seqs).collect()
    reference = Tokenizer.from_file(P.tokenizer_path())
    want = []
    for i, t, _ in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        k, start = 0, 0
        size = len(ids) if len(ids) <= capacity else (len(ids) % capacity or capacity)
        while start < len(ids):
            part = ids[start : start + size]
            want.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            k, start, size = k + 1, start + len(part), capacity
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
        total += at
    assert len(by) <= 1.25 * -(-total // capacity) + 2


def test_empty_table(spark):
    assert P.placed(P.pack(spark.createDataFrame([], SCHEMA))).collect() == []


def test_added_token_within_texts(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.tokenizer_path())
    token = "<|endoftext|>"
    texts = [token, f"{token} x", f"one  {token}\n\ntwo{token}{token} 'll", f"  {token}  ", "<|endoftext|", f"<|endoftext{token}>", "naïve 東京"]
    for t in texts:
        assert P.encode_text(t, P.tokenizer_path()) == reference.encode(t, add_special_tokens=False).ids
    got = P.placed(P.pack(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA))).collect()
    want = [np.array([*reference.encode(t, add_special_tokens=False).ids, P.END], "<u4") for t in texts]
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)}
