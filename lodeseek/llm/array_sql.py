"""SQL of array columns whose work grows with the array, not with its square."""

from __future__ import annotations

#: Elements that one list is appended to one by one; lists of that length are then put together.
BLOCK = 1024


def scan(array: str, zero: str, step: str, element: str, kind: str) -> str:
    """SQL of the array with ``element`` for every x of the column ``array``, in order.

    ``element`` and ``step`` are SQL over ``a.s``, the state before x, and x; ``step`` is the state
    after it, ``zero`` the first one.  Spark copies an array for each element appended to it, so the
    elements are gathered in blocks.
    """
    blocks = f"transform(sequence(0, CAST((greatest(size({array}), 1) - 1) div {BLOCK} AS INT)), b -> slice({array}, b * {BLOCK} + 1, {BLOCK}))"
    block = f"aggregate(k, named_struct('s', t.s, 'o', CAST(array() AS array<{kind}>)), (a, x) -> named_struct('s', {step}, 'o', a.o || array({element})), a -> named_struct('s', a.s, 'o', t.o || array(a.o)))"
    return f"flatten(aggregate({blocks}, named_struct('s', {zero}, 'o', CAST(array() AS array<array<{kind}>>)), (t, k) -> {block}, t -> t.o))"


def quoted(pattern: str) -> str:
    """A regular expression as it stands within a SQL string."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def matches(d, column: str, pattern: str, text: str, around: int = 0, when: str = "true"):
    """Adds ``column``: the pattern's matches in ``text``, leftmost first and without overlap, as
    structs v, start, end (code points, end exclusive) and, if ``around`` is not 0, before and after
    (that many characters, matches near by included); and ``<column>_gaps``: the texts between them."""
    from pyspark.sql import functions as F

    rx, v, g, n, s = quoted(pattern), f"{column}_v", f"{column}_gaps", f"{column}_n", f"{column}_s"
    d = d.withColumn(v, F.expr(f"CASE WHEN {when} THEN regexp_extract_all({text}, '{rx}', 0) ELSE CAST(array() AS array<string>) END"))
    d = d.withColumn(g, F.expr(f"CASE WHEN size({v}) > 0 THEN split({text}, '{rx}', -1) ELSE array({text}) END"))
    # a match starts after all gaps and matches before it
    # two mentions of the gaps, or the optimizer would move their split into the lambda
    d = d.withColumn(n, F.expr(f"CASE WHEN size({g}) > size({v}) THEN transform({v}, (v, i) -> named_struct('g', length({g}[i]), 'n', length(v))) ELSE CAST(array() AS array<struct<g:int,n:int>>) END"))
    d = d.withColumn(s, F.expr(scan(n, "0", "a.s + x.g + x.n", "a.s + x.g", "int")))
    before = f"right(concat(CASE WHEN i > 0 THEN concat(right({g}[i - 1], {around}), {v}[i - 1]) ELSE '' END, {g}[i]), {around})"
    after = f"left(concat({g}[i + 1], CASE WHEN i + 1 < size({v}) THEN concat({v}[i + 1], left({g}[i + 2], {around})) ELSE '' END), {around})"
    context = f", 'before', {before}, 'after', {after}" if around else ""
    d = d.withColumn(column, F.expr(f"transform({v}, (v, i) -> named_struct('v', v, 'start', {s}[i], 'end', {s}[i] + length(v){context}))"))
    return d.drop(v, n, s)
