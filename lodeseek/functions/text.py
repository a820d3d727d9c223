"""Text expressions: lines, literals, docstrings, query classes.  All are Columns, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a question, and weights of the vector side by query class.
QUESTION_WORDS = ["how", "what", "where", "why", "when", "which", "can", "does", "is", "are", "should", "could", "would"]
ALPHA = {"Keyword": 0.3, "Semantic": 0.8, "Hybrid": 0.5}

#: Closed literals of three quote styles, then an unclosed one that takes the rest.
LITERAL = r""""(?:[^"\\]|\\[\s\S])*+"|'(?:[^'\\]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`|["'`][\s\S]*\z"""
LITERAL_BYTES = 100
TOKEN = r"[\p{L}\p{N}]+"
TOKEN_BYTES = 40
SPECIAL = r"[:()\[\]{}^\"~*?\\/]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """Lines without their ends; one final end closes the last line and adds none; "" has none."""
    t = _col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), r"\r?\n"))


def is_blank(text: Column | str) -> Column:
    return F.trim(F.translate(_col(text), "\t\n\x0b\x0c\r", " ")) == ""


def string_literals(text: Column | str) -> Column:
    """Contents of the quoted literals, left to right, unescaped; not blank, under 100 bytes."""
    found = F.regexp_extract_all(_col(text), F.lit(LITERAL), 0)
    closed = F.filter(found, lambda x: (F.length(x) > 1) & (F.substring(x, 1, 1) == F.right(x, F.lit(1))) & x.rlike(r"\A(?:" + LITERAL.rsplit("|", 1)[0] + r")\z"))
    inner = F.transform(closed, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\([\s\S])", "$1"))
    return F.filter(inner, lambda x: ~is_blank(x) & (F.octet_length(x) < LITERAL_BYTES))


def clean_docstring(doc: Column | str) -> Column:
    """A docstring without its delimiters and comment marks, on one line."""
    t = F.trim(_col(doc))
    for left, right in (('"""', '"""'), ("'''", "'''"), ("/**", "*/")):
        both = t.startswith(left) & t.endswith(right) & (F.length(t) >= len(left) + len(right))
        t = F.when(both, F.substr(t, F.lit(len(left) + 1), F.length(t) - len(left) - len(right))).otherwise(t)
    rows = F.transform(lines(t), lambda x: F.trim(F.regexp_replace(F.trim(F.translate(x, "\t", " ")), r'\A(?:///|//!|//|\*|")', "")))
    return F.array_join(F.filter(rows, lambda x: x != ""), " ")


def prepare_text(context: Column | str, signature: Column | str, docstring: Column | str, content: Column | str) -> Column:
    """What is embedded for a chunk: labelled parts on lines of their own, empty ones left out."""
    ctx, sig, doc = _col(context), _col(signature), clean_docstring(docstring)
    return F.concat_ws(
        "\n",
        F.when(F.size(ctx) > 0, F.concat(F.lit("Context: "), F.array_join(ctx, " > "))),
        F.when(sig != "", F.concat(F.lit("Signature: "), sig)),
        F.when(doc != "", F.concat(F.lit("Documentation: "), doc)),
        F.concat(F.lit("Code:\n"), _col(content)),
    )


def estimate_tokens(text: Column | str) -> Column:
    return F.ceil(F.octet_length(_col(text)) / 4).cast("long")


def words(query: Column | str) -> Column:
    return F.filter(F.split(_col(query), r"\s+"), lambda w: w != "")


def classify_query(query: Column | str) -> Column:
    """Keyword, Semantic or Hybrid; the first rule that holds decides."""
    q, w = _col(query), words(query)
    n, one = F.size(w), ~_col(query).contains(" ")
    code = F.lit(False)
    for mark in ("::", "()", "->", "=>"):
        code = code | q.contains(mark)
    camel = q.rlike(r"\p{Lu}") & q.rlike(r"\p{Ll}") & one
    return (
        F.when(n == 1, "Keyword")
        .when(F.arrays_overlap(F.transform(w, F.lower), F.array(*map(F.lit, QUESTION_WORDS))), "Semantic")
        .when(code, "Keyword")
        .when(q.contains("<") & q.contains(">"), "Keyword")
        .when(camel | (q.contains("_") & one), "Keyword")
        .when(n <= 3, "Hybrid")
        .when(n >= 5, "Semantic")
        .otherwise("Hybrid")
    )


def query_alpha(kind: Column | str) -> Column:
    c = F.lit(None).cast("double")
    for name, value in ALPHA.items():
        c = F.when(_col(kind) == name, F.lit(value)).otherwise(c)
    return c


def tokens(text: Column | str) -> Column:
    """Index terms: runs of letters and digits, lower case, those of 40 bytes or more dropped."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), 0), lambda x: F.octet_length(x) < TOKEN_BYTES)


def without_special(query: Column | str) -> Column:
    """The fallback for queries that do not parse: special characters become spaces."""
    return F.regexp_replace(_col(query), SPECIAL, " ")


def snippet(content: Column | str, n: int = 3, width: int = 100) -> Column:
    """The first lines on one line, cut to ``width`` characters."""
    s = F.array_join(F.slice(lines(content), 1, n), " ")
    return F.when(F.length(s) > width, F.concat(F.left(s, F.lit(width)), F.lit("..."))).otherwise(s)


def truncated(content: Column | str, width: int = 200) -> Column:
    c = _col(content)
    return F.when(F.octet_length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)
