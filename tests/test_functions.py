import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V
from lodeseek.sources import languages as L


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression.alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\n"]
    assert values(spark, texts, T.lines("t")) == [[], [""], ["a"], ["a"], ["a", ""], ["a", "b"]]


def test_literals(spark):
    long = "x" * 99
    texts = ['a "b" \'c\' `d` "e\\"f"', f'"{long}" "{long}y"', "it's \"q\"", '" " ""', "open 'rest"]
    assert values(spark, texts, T.string_literals("t")) == [["b", "c", "d", 'e"f'], [long], [], [], []]


def test_query_classes(spark):
    cases = {
        "HashMap": "Keyword", "process_payment": "Keyword", "std::collections::HashMap": "Keyword", "foo()": "Keyword", "Result<T, E>": "Keyword", "a < b > c": "Keyword",
        "how does it work": "Semantic", "Where is the parser": "Semantic", "find the function that sorts rows": "Semantic",
        "sort function": "Hybrid", "database connection pool": "Hybrid", "four plain words here": "Hybrid", "": "Hybrid", "tell me how?": "Hybrid", "one\ttwo  three": "Hybrid",
    }
    assert dict(zip(cases, values(spark, list(cases), T.classify_query("t")), strict=True)) == cases
    assert values(spark, ["Keyword", "Semantic", "Hybrid"], T.query_alpha("t")) == [0.3, 0.8, 0.5]


def test_docstrings_and_prepared_text(spark):
    assert values(spark, ["/// One\n/// two", '"""Doc\n  more"""', "/** A\n * b\n */"], T.clean_docstring("t")) == ["One two", "Doc more", "A b"]
    d = spark.createDataFrame([(["File: a", "Class: B"], "def f()", '"""Doc."""', "x"), ([], None, None, "y")], "c array<string>, s string, d string, t string")
    got = [r.v for r in d.select(T.prepare_text("c", "s", "d", "t").alias("v")).collect()]
    assert got == ["Context: File: a > Class: B\nSignature: def f()\nDocumentation: Doc.\nCode:\nx", "Code:\ny"]


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r.v, 6) for r in d.select(V.cosine(F.col("a"), F.col("b")).alias("v")).collect()] == [1, 0, 0, 0, 0.707107]
    with pytest.raises(Exception, match="dimensions"):
        d.select(V.checked(F.col("b"), 2)).collect()


def test_files(spark):
    paths = ["a/b.rs", "x.PY", "y.tsx", "z.min.js", ".gitignore", "noext", "a.b/c", "q.lock"]
    assert values(spark, paths, L.language(F.col("t"))) == ["Rust", "Python", "TypeScript", "JavaScript", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert values(spark, paths, L.binary_by_extension(F.col("t")))[-1]
    assert values(spark, ["/a/target/x", "/a/targets/x"], L.in_excluded_dir(F.col("t"))) == [True, False]
    d = spark.createDataFrame([(bytearray(b),) for b in (b"", b"plain\n", b"a\x00b", b"\x01" * 1000, "日本語テキスト".encode(), b"\xff\xfe\xfd" * 10)], "b binary")
    assert [r.v for r in d.select(L.binary_by_content(F.col("b")).alias("v")).collect()] == [False, False, True, True, True, True]


def test_ignore_patterns(spark):
    rules = ["# note", "", "*.log", "!keep.log", "/top", "dir/", "a/**/z", "b?.txt", "[xy].c"]
    paths = ["k.log", "d/k.log", "keep.log", "top/f", "in/top", "q/dir/f", "dir", "a/z", "a/m/n/z", "b1.txt", "x.c", "z.c"]
    assert values(spark, paths, L.ignored(F.col("t"), rules)) == [True, True, False, True, False, True, False, True, True, True, True, False]


def test_dbt(spark):
    texts = ["{{ ref('a') }}", "{% macro m() %}", "{{ config (x) }}", "{{ x }}", "ref(a)", "{{source('s','t')}}"]
    assert values(spark, texts, L.is_dbt(F.col("t"))) == [True, True, True, False, False, True]
