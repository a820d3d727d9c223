"""Personal data by candidate gradient boosting: DataFrame functions only.

Base patterns give the spans of e-mail addresses, IP addresses, payment cards and phone numbers;
these always stay.  High-recall generators propose more, overlapping spans: digit groups that could
be a phone number, an account or an identity number, spelled-out e-mail addresses, international
bank accounts.  Gradient-boosted trees of MLlib look at each proposal's format and surroundings; a
logistic curve over their margin gives its probability, which must reach the kind's threshold.  Of
proposals that overlap the likeliest stays, none that overlaps a base span.  Trees and curve become
one SQL expression, so a text is searched and judged within one projection, without a shuffle.

No labelled candidates come with the data: ``labelled_candidates`` makes CANDIDATES rows by rule, two
thirds to fit the trees, the rest to calibrate: the curve is fitted to them, and each kind's threshold
is the least probability from which they reach the precision PRECISION.

Defined results: null and empty texts have no spans; repeated rows are searched each; an empty table
gives an empty result; only doc_id and text are taken, so other columns' names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree_sql
from .array_sql import matches, scan
from .storage import written

CANDIDATES = 3000
ROUNDS, DEPTH, SEED = 20, 4, 11
PRECISION, HIGHEST = 0.98, 0.995
AROUND = 30
#: Proposals to look at on either side for overlaps: those of three kinds within the longest span.
NEAR = 64

# Fixed patterns of the base kinds, in the order in which kinds are listed; written so that Java
# matches the same spans without recursion or repeated attempts within a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its kind to be looked for: cheap tests first.
HINT = {"email": "contains({t}, '@')", "ip": "{t} RLIKE '[0-9][.][0-9]'", "card": "{t} RLIKE '[0-9][0-9 -]{{9}}'", "phone": "contains({t}, '+')"}
#: Kinds that the method adds: proposals of the generators.
ADDED = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "address": r"[A-Za-z0-9._%+-]{1,64}+\s?(?:\[at\]|\(at\))\s?[A-Za-z0-9-]{1,64}+\s?(?:\[dot\]|\(dot\)|\.)\s?[A-Za-z]{2,10}",
    "number": r"(?<![A-Za-z0-9+.])\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,18}+(?![A-Za-z0-9])",
}
ADDED_HINT = {"account": "{t} RLIKE '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}'", "address": "{t} RLIKE '[(\\\\[]at[)\\\\]]'", "number": "{t} RLIKE '[0-9](?:[ ().-]{{0,2}}+[0-9]){{6}}'"}
KINDS = [*BASE, *ADDED]

PHONE_WORDS = "(?i)\\\\b(?:tel|phone|call|mobile|cell|fax|contact|whatsapp|rufnummer|telefon|appel|llame)"
ID_WORDS = "(?i)\\\\b(?:ssn|social|passport|identity|national id|tax id|account|iban|konto|compte|cuenta|born|birth|dob|licen[cs]e)"
OTHER_WORDS = "(?i)\\\\b(?:order|invoice|version|build|ticket|isbn|sku|part|commit|ref|serial|model|page|chapter|line|total|price|sum|usd|eur|size|count|bytes|seconds|year)"


def _luhn(v: str) -> str:
    """Whether the digits of a string pass the Luhn sum."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    return f"aggregate(transform(filter(split(reverse({d}), ''), x -> x <> ''), (x, i) -> CASE WHEN i % 2 = 0 THEN int(x) WHEN int(x) > 4 THEN 2 * int(x) - 9 ELSE 2 * int(x) END), 0, (a, x) -> a + x) % 10 = 0"


def _digits(v: str) -> str:
    return f"length(regexp_replace({v}, '[^0-9]', ''))"


CHECKS = {
    "email": "true",
    "ip": "forall(split(v, '[.]'), p -> coalesce(try_cast(p AS INT) <= 255, false))",
    "card": f"{_digits('v')} BETWEEN 12 AND 19 AND {_luhn('v')}",
    "phone": f"{_digits('v')} BETWEEN 9 AND 15",
}


def with_base(documents: DataFrame) -> DataFrame:
    """Adds a column for each base kind: its spans that pass the kind's check."""
    d = documents
    for kind, pattern in BASE.items():
        d = matches(d, kind, pattern, "text", when=HINT[kind].format(t="text")).drop(f"{kind}_gaps")
        check = CHECKS[kind].replace("(v,", "(c.v,").replace("(v)", "(c.v)").replace("regexp_replace(v", "regexp_replace(c.v")
        d = d.withColumn(kind, F.expr(f"filter({kind}, c -> {check})"))
    return d


#: Features of a proposal, over a struct c and the kind's number.
FEATURES = [
    "{kind}D",
    "CAST(length(c.v) AS DOUBLE)",
    f"CAST({_digits('c.v')} AS DOUBLE)",
    "CAST(regexp_count(c.v, '[ -]') AS DOUBLE)",
    "CAST(regexp_count(c.v, '[().]') AS DOUBLE)",
    "CAST(regexp_count(c.v, '[A-Za-z]') AS DOUBLE)",
    f"CAST({_luhn('c.v')} AS DOUBLE)",
    r"CAST(c.v RLIKE '\\A[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\z' AS DOUBLE)",
    r"CAST(c.v RLIKE '\\A(?:[(]?[0-9]{{2,5}}[)]?[ .-]?)[0-9]{{3,4}}[ .-][0-9]{{3,4}}\\z' AS DOUBLE)",
    r"CAST(c.v RLIKE '\\A(?:19|20)[0-9]{{2}}[-.]?[01][0-9][-.]?[0-3][0-9]' AS DOUBLE)",
    f"CAST(c.before RLIKE '{PHONE_WORDS}[^.\\\\n]{{{{0,20}}}}\\\\z' AS DOUBLE)",
    f"CAST(c.before RLIKE '{ID_WORDS}[^.\\\\n]{{{{0,20}}}}\\\\z' AS DOUBLE)",
    f"CAST(c.before RLIKE '{OTHER_WORDS}[^.\\\\n]{{{{0,20}}}}\\\\z' AS DOUBLE)",
    "CAST(c.before RLIKE '[:=#]\\\\s*\\\\z' AS DOUBLE)",
    "CAST(c.before RLIKE '[$€£]\\\\s*\\\\z' AS DOUBLE)",
    "CAST(c.after RLIKE '\\\\A\\\\s*(?:%|[$€£]|px|kb|mb|ms|usd|eur)' AS DOUBLE)",
]


def with_proposals(documents: DataFrame) -> DataFrame:
    """Adds ``proposed``: the generators' spans of all added kinds with their features."""
    d = documents
    for kind, pattern in ADDED.items():
        d = matches(d, f"p_{kind}", pattern, "text", AROUND, ADDED_HINT[kind].format(t="text")).drop(f"p_{kind}_gaps")
    each = []
    for k, kind in enumerate(ADDED):
        features = ", ".join(f.format(kind=k) for f in FEATURES)
        each.append(f"transform(p_{kind}, c -> named_struct('kind', '{kind}', 'start', c.start, 'end', c.end, 'f', array({features})))")
    return d.withColumn("proposed", F.expr(f"concat({', '.join(each)})")).drop(*(f"p_{k}" for k in ADDED))


def labelled_candidates(spark: SparkSession, n: int = CANDIDATES) -> DataFrame:
    """(id, text, label): texts with one proposal each, by rule."""
    rows = spark.range(n, numPartitions=1).selectExpr("id", "translate(sha2(concat('p', id), 512), 'abcdef', '381604') AS x", "upper(sha2(concat('q', id), 256)) AS y", "id % 20 AS kind", "id div 20 AS k")
    pick = lambda words, at: f"element_at(array({', '.join(repr(w) for w in words)}), 1 + cast(conv(substr(y, {at}, 4), 16, 10) % {len(words)} as int))"
    phone, identity, other = pick(["tel: ", "phone ", "call me at ", "mobile: ", "Telefon ", "contact "], 1), pick(["SSN: ", "social security number ", "passport ", "tax id ", "Konto ", "account no. "], 1), pick(["order ", "invoice #", "version ", "ticket ", "ISBN ", "part no. ", "total ", "build "], 1)
    plain = pick(["of the ", "und der ", "est la ", "los que ", "thern and ", ""], 1)
    value = f"""CASE kind
        WHEN 0 THEN concat({phone}, '(', substr(x, 1, 3), ') ', substr(x, 4, 3), '-', substr(x, 7, 4))
        WHEN 1 THEN concat({phone}, substr(x, 1, 3), '-', substr(x, 4, 3), '-', substr(x, 7, 4))
        WHEN 2 THEN concat({phone}, '0', substr(x, 1, 3), ' ', substr(x, 4, 7))
        WHEN 3 THEN concat({identity}, substr(x, 1, 3), '-', substr(x, 4, 2), '-', substr(x, 6, 4))
        WHEN 4 THEN concat({identity}, substr(x, 1, 9))
        WHEN 5 THEN concat({pick(["IBAN ", "Konto: ", "account ", ""], 1)}, {pick(["DE", "FR", "ES", "GB"], 5)}, substr(x, 1, 20))
        WHEN 6 THEN concat(lower(substr(y, 1, 5)), {pick([" (at) ", " [at] ", "(at)"], 9)}, 'mail', {pick([".com", " (dot) org", "[dot]net"], 13)})
        WHEN 7 THEN concat({phone}, substr(x, 1, 3), '.', substr(x, 4, 3), '.', substr(x, 7, 4))
        WHEN 8 THEN concat({plain}, '(', substr(x, 1, 3), ') 555-', substr(x, 7, 4))
        WHEN 9 THEN concat({identity}, substr(x, 1, 8))
        WHEN 10 THEN concat({other}, substr(x, 1, 10))
        WHEN 11 THEN concat({other}, substr(x, 1, 4), '-', substr(x, 5, 6))
        WHEN 12 THEN concat({plain}, substr(x, 1, 11))
        WHEN 13 THEN concat({plain}, '2019-0', 1 + k % 9, '-1', k % 10)
        WHEN 14 THEN concat({pick(["$", "€ ", "total "], 1)}, substr(x, 1, 9))
        WHEN 15 THEN concat({plain}, substr(x, 1, 7), {pick([" px", " ms", "%", " eur"], 5)})
        WHEN 16 THEN concat({other}, '978-', substr(x, 1, 1), '-', substr(x, 2, 4), '-', substr(x, 6, 4), '-', substr(x, 10, 1))
        WHEN 17 THEN concat({other}, {pick(["AB", "XK", "SN"], 5)}, substr(x, 1, 18))
        WHEN 18 THEN concat({plain}, substr(x, 1, 3), ' ', substr(x, 4, 3), ' ', substr(x, 7, 3))
        ELSE concat({plain}, substr(x, 1, 16)) END"""
    return rows.selectExpr("id", f"concat({value}, {pick(['', ' the and', '.', ' von der'], 21)}) AS text", "CAST(kind < 10 AS DOUBLE) AS label")


class Judge:
    """The calibrated probability over a struct c with c.f, and each added kind's threshold."""

    def __init__(self, probability: str, thresholds: dict[str, float]):
        self.probability, self.thresholds = probability, thresholds


def train(spark: SparkSession, labelled: DataFrame | None = None) -> Judge:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    # written between the steps: else Spark would make the rows anew within each expression
    made = written(labelled if labelled is not None else labelled_candidates(spark), "labelled")
    rows = written(with_proposals(made).selectExpr("id", "label", "explode(proposed) AS c"), "proposals").withColumn("features", array_to_vector("c.f"))
    fit = F.pmod(F.xxhash64("id"), F.lit(3)) < 2
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, stepSize=0.3, subsamplingRate=0.9).fit(rows.where(fit).coalesce(1))
    # a logistic curve over the margins of rows that the trees have not seen
    margin = tree_sql.boosted_margin(model, "c.f")
    held = written(rows.where(~fit).selectExpr("c.kind AS kind", "label", f"{margin} AS margin"), "margins")
    curve = LogisticRegression(regParam=1e-3).fit(held.select("label", array_to_vector(F.array("margin")).alias("features")).coalesce(1))
    probability = f"(1D / (1D + exp(-({float(curve.coefficients[0])!r}D * {margin} + {float(curve.intercept)!r}D))))"
    # CANDIDATES rows at most, by rule
    seen = [(r.kind, 1 / (1 + math.exp(-(curve.coefficients[0] * r.margin + curve.intercept))), r.label) for r in held.collect()]
    thresholds = {}
    for kind in ADDED:
        own, right, best = sorted(((p, label) for k, p, label in seen if k == kind), reverse=True), 0, HIGHEST
        for k, (p, label) in enumerate(own, 1):
            right += label
            if right >= PRECISION * k:
                best = p
        thresholds[kind] = max(0.5, min(best, HIGHEST))
    return Judge(probability, thresholds)


def _apart_from_base(d: DataFrame) -> DataFrame:
    """``added`` without the proposals that overlap a base span: one look from either side."""
    both = "sort_array(concat(transform(base, b -> named_struct('start', b.start, 'added', false, 'end', b.end, 'rank', b.rank, 'p', 1D, 'hit', false)), transform(added, c -> named_struct('start', c.start, 'added', true, 'end', c.end, 'rank', c.rank, 'p', c.p, 'hit', false))))"
    kind = "struct<start:int,added:boolean,end:int,rank:int,p:double,hit:boolean>"
    same = "named_struct('start', x.start, 'added', x.added, 'end', x.end, 'rank', x.rank, 'p', x.p, 'hit', {})"
    d = d.withColumn("both", F.expr(f"CASE WHEN size(added) > 0 AND size(base) > 0 THEN {both} ELSE CAST(array() AS array<{kind}>) END"))
    d = d.withColumn("both", F.expr(scan("both", "0", "CASE WHEN x.added THEN a.s ELSE greatest(a.s, x.end) END", same.format("a.s > x.start"), kind)))
    d = d.withColumn("both", F.expr("reverse(both)"))
    d = d.withColumn("both", F.expr(scan("both", "2147483647", "CASE WHEN x.added THEN a.s ELSE x.start END", same.format("x.hit OR a.s < x.end"), kind)))
    free = "transform(filter(both, x -> x.added AND NOT x.hit), x -> named_struct('start', x.start, 'end', x.end, 'rank', x.rank, 'p', x.p))"
    return d.withColumn("added", F.expr(f"sort_array(CASE WHEN size(base) > 0 THEN {free} ELSE added END)")).drop("both")


def _best_of_overlapping(d: DataFrame) -> DataFrame:
    """``added``, sorted, without the proposals that overlap a likelier one which stays (of equal ones
    the longer, then the kind listed first).  Proposals are short, so those that overlap stand near."""
    near = f"sequence(greatest(0, i - {NEAR}), least(size(added) - 1, i + {NEAR}))"
    meet = "added[j].start < x.end AND x.start < added[j].end"
    longer = "added[j].end - added[j].start > x.end - x.start"
    better = f"(added[j].p > x.p OR (added[j].p = x.p AND ({longer} OR (added[j].end - added[j].start = x.end - x.start AND added[j].rank < x.rank))))"
    field = "'start', x.start, 'end', x.end, 'rank', x.rank, 'p', x.p"
    for _ in range(len(ADDED)):
        # most meet no other: none before ends, none behind begins within it
        d = d.withColumn("added", F.expr(scan("added", "0", "greatest(a.s, x.end)", f"named_struct({field}, 'meets', a.s > x.start)", "struct<start:int,end:int,rank:int,p:double,meets:boolean>")))
        meets = "(x.meets OR coalesce(get(added, i + 1).start < x.end, false))"
        d = d.withColumn("added", F.expr(f"transform(added, (x, i) -> named_struct({field}, 'meets', {meets}, 'best', NOT {meets} OR NOT exists({near}, j -> {meet} AND {better})))"))
        d = d.withColumn("added", F.expr(f"filter(added, (x, i) -> x.best OR NOT exists({near}, j -> added[j].best AND {meet}))"))
    return d.withColumn("added", F.expr("filter(added, x -> x.best)"))


def find(documents: DataFrame, judge: Judge | None = None) -> DataFrame:
    """doc_id, text, a column of spans for each base kind, ``base``: these in order, ``added``: the
    chosen proposals with their probability, and ``spans``: all spans in order."""
    judge = judge or train(documents.sparkSession)
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_proposals(with_base(d))
    least = " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in judge.thresholds.items())
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    d = d.withColumn("added", F.expr(f"filter(transform(proposed, c -> named_struct('start', c.start, 'end', c.end, 'rank', CASE c.kind {rank} END, 'p', {judge.probability}, 'least', CASE c.kind {least} END)), c -> c.p >= c.least)"))
    base = [f"transform({k}, c -> named_struct('start', c.start, 'rank', {i}, 'end', c.end, 'kind', '{k}'))" for i, k in enumerate(BASE)]
    d = d.withColumn("base", F.expr(f"sort_array(concat({', '.join(base)}))"))
    d = _best_of_overlapping(_apart_from_base(d.withColumn("added", F.expr("transform(added, c -> named_struct('start', c.start, 'end', c.end, 'rank', c.rank, 'p', c.p))"))))
    names = ", ".join(f"'{k}'" for k in KINDS)
    extra = f"transform(added, c -> named_struct('start', c.start, 'rank', c.rank, 'end', c.end, 'kind', array({names})[c.rank]))"
    return d.withColumn("spans", F.expr(f"sort_array(concat(base, {extra}))"))


def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')"
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return d.select("doc_id", *counts, F.expr(f"sha2({joined.format('base')}, 256)").alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
