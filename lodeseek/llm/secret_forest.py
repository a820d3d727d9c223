"""Secret scans with a random forest that removes false positives: DataFrame functions only.

High-recall patterns propose candidates: values assigned to a name that speaks of a credential,
tokens of known issuers, and long mixed tokens.  Each candidate gets features - length, entropy,
changes between letter and digit, runs, share of letters that a dictionary of syllables covers, path
of the source, words before and after it - and a random forest of MLlib, trained from labelled
findings, votes.  The forest is turned into one SQL expression, so a text is scanned, scored and
redacted within a single projection: no shuffle, and work in proportion to a text's length.

No table of labelled findings comes with the data.  ``labelled_findings`` makes one of FINDINGS rows
by rule: issued keys, assigned random values and passwords against hashes named as such, versions,
identifiers, numbers, words and templates' placeholders, in several surroundings.

Defined results: null and empty texts have no candidates; a null source is an empty path; repeated
rows are scanned each; an empty table gives an empty result; the caller's columns, whatever their
names, pass ``redact`` apart from the operator's own.

A value of any length is one candidate.  Behind the name of a credential, a sign and any number of
blanks it is the whole quotation if it stands in quotation marks (escaped ones do not end it, a line's end
does), else all up to the next white space, six characters at least, without the closing punctuation at
its end; it also ends before ``&``, ``;`` or ``,`` if a name of letters and an equals sign follow, for there
the next setting begins.  Of ``scheme://user:password@host`` the password is a candidate.  Values with
other names have six characters at least and end before a blank, a quotation mark, a comma, a semicolon
or an equals sign; the port and path of an address are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree_sql
from .array_sql import matches, quoted
from .storage import written

FINDINGS = 3000
TREES, DEPTH, SEED = 24, 6, 17
#: Share of the trees from which a candidate is a secret.
VOTES = 0.5
#: Characters of context on either side.
AROUND = 40
REPLACEMENT = "[SECRET]"

#: Names of credentials, and what stands between such a name and its value.
CREDENTIAL = r"(?i:secret(?:[_-]?key)?|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
SIGN = r"\\?[\"'`]?\s*+(?:=>|:=|={1,3}|:)\s*+"
USER = r"://[^\s:/@\"'<>]*+:"
#: The whole content of a quotation, and a value without quotation marks.
QUOTATION = "|".join(rf"{q}(?!{q})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+(?={q})" for q in "\"'`")
PLAIN = r"[\"'`]?+(?![\"'`]|-----BEGIN )(?=\S{6})(?:[^\s&;,]++|[&;,](?![A-Za-z_]{2,30}+=))++"
#: What a value without quotation marks does not end with.
CLOSING = "\"'`\\.,;:)]}>"

#: A long mixed token, but no name of a credential in front of its value.
LONG = rf"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{{12,}}+(?!(?<={CREDENTIAL}){SIGN})={{0,2}}+(?![A-Za-z0-9_])"
#: What stands in front of any other value; a sign may end the match before.
ASSIGNED = r"(?:=|:(?!//))\s{0,8}+|[\"']|\G(?<=[=:])\s{0,8}+"

#: The port in an address is no value.
PORT = r"[0-9]{1,5}+(?=/)(?<=://[A-Za-z0-9.-]{1,253}:[0-9]{1,5})"

#: A candidate, leftmost first and without overlap.  Possessive, so that long runs cost no recursion.
#: Names and signs in front of values belong to the match and are parted from the values later.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?=[abcpstABCPST]){CREDENTIAL}{SIGN}(?:{QUOTATION}|{PLAIN})"
    rf"|{USER}[^\s/\"'<>]+(?=@)"
    rf"|{LONG}"
    rf"|(?:{ASSIGNED})(?!{LONG}|{PORT}|://|-----BEGIN |[A-Za-z0-9_./+-]*{CREDENTIAL}{SIGN}|[A-Za-z0-9+.-]*+{USER}[^\s/\"'<>]+@)[^\s\"'=,;]{{6,}}+"
)
#: The part of a match in front of its value.
FRONT = rf"\A(?:{CREDENTIAL}{SIGN}[\"'`]?+|{USER}|[=:]\s*+|[\"']|\s++)"
NAMES = rf"{CREDENTIAL}[\"']?\s*(?:=>|[:=]|\s)\s*[\"']?\z"
#: Names of values that are no secrets though they look like it.
HARMLESS = r"(?i)(?:sha(?:1|256|512)?|md5|checksum|digest|commit|revision|rev|hash|etag|uuid|guid|version|build|id|order|invoice|number|example|sample|placeholder|dummy|url|href|src|color)[\"']?\s*(?:=>|[:=#]|\s)\s*[\"']?\z"
ISSUED = r"\A(?:AKIA|ASIA)[0-9A-Z]{16}\z|\Agh[pousr]_[A-Za-z0-9]{36,}\z|\Axox[abprs]-[A-Za-z0-9-]{10,}\z|\Ask_(?:live|test)_[A-Za-z0-9]{16,}\z|\AAIza[0-9A-Za-z_-]{35}\z|\Aglpat-[A-Za-z0-9_-]{20}\z|\A-----BEGIN |\AeyJ[A-Za-z0-9_-]{10,}"
SYLLABLES = "(?i)the|and|ing|tion|ent|ion|her|for|tha|nth|int|ere|ter|est|ers|ati|hat|ate|all|eth|hes|ver|his|oft|ith|que|les|ment|des|der|die|und|sch|ein|ich|ung|ado|con|los|ar|er|in|on|re|an|en|at|es|st|or|te|ti|le|de|la"
PATHS = r"(?i)\.env|config|secret|credential|\.pem|\.key|settings|\.ya?ml|\.tf|\.ini|\.sh"


def _count(pattern: str) -> str:
    return f"CAST(regexp_count(c.v, '{pattern}') AS DOUBLE)"


#: The features, over a struct c (v: value, before, after, path).
FEATURES = [
    "CAST(least(length(c.v), 200) AS DOUBLE)",
    # entropy in bits a character, over the runs of its sorted characters
    r"aggregate(regexp_extract_all(array_join(sort_array(split(c.v, '')), ''), '(?s)(.)\\1*+', 0), 0D, (a, r) -> a - length(r) / length(c.v) * log2(length(r) / length(c.v)))",
    _count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]") + " / length(c.v)",
    _count("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") + " / length(c.v)",
    _count("[0-9]") + " / length(c.v)",
    _count("[^A-Za-z0-9]") + " / length(c.v)",
    _count("(.)\\\\1") + " / length(c.v)",
    "1D - CAST(length(regexp_replace(c.v, '" + SYLLABLES + "', '')) AS DOUBLE) / length(c.v)",
    "CAST(c.v RLIKE '\\\\A[0-9a-fA-F]+\\\\z' AS DOUBLE)",
    f"CAST(c.v RLIKE '{quoted(ISSUED)}' AS DOUBLE)",
    f"CAST(c.front RLIKE '\\\\A[A-Za-z]' OR c.before RLIKE '{quoted(NAMES)}' AS DOUBLE)",
    "CAST(startswith(c.front, '://') AS DOUBLE)",
    _count("[ \\\\t]") + " / length(c.v)",
    f"CAST(c.before RLIKE '{quoted(HARMLESS)}' AS DOUBLE)",
    r"CAST(c.front RLIKE '[=:]' OR c.before RLIKE '[=:]\\s*[\"\']?\\z' AS DOUBLE)",
    r"CAST(c.v RLIKE '(?i)example|sample|changeme|your|xxxx|placeholder|dummy|<|\\$\\{|[A-Za-z]\\(|[a-z][.\\[][A-Za-z\"\']' AS DOUBLE)",
    f"CAST(c.path RLIKE '{quoted(PATHS)}' AS DOUBLE)",
    # neighbouring words on either side, and how much of them the dictionary covers
    "CAST(size(filter(split(c.before, '[^A-Za-z]+'), w -> length(w) > 2)) AS DOUBLE)",
    "CAST(size(filter(split(c.after, '[^A-Za-z]+'), w -> length(w) > 2)) AS DOUBLE)",
    "1D - CAST(length(regexp_replace(concat(c.before, c.after), '" + SYLLABLES + "', '')) AS DOUBLE) / greatest(1, length(concat(c.before, c.after)))",
    r"CAST(c.after RLIKE '\\A[\"\';,)]*\\s*(?:\\z|\n)' AS DOUBLE)",
]


def with_candidates(documents: DataFrame) -> DataFrame:
    """Adds ``found`` (structs v, start, end, f) and ``found_gaps`` (the texts between) to the columns
    text and source; other columns of these names must not be there."""
    d = documents.withColumn("whole", F.coalesce("text", F.lit("")))
    d = matches(d, "found", CANDIDATE, "whole", AROUND).drop("whole")
    # what stands in front of a value and what closes it go to the texts between
    d = d.withColumn("found", F.expr(f"transform(found, c -> named_struct('c', c, 'front', regexp_extract(c.v, '{quoted(FRONT)}', 0)))"))
    d = d.withColumn("found", F.expr("transform(found, x -> named_struct('c', x.c, 'front', x.front, 'v', substr(x.c.v, length(x.front) + 1)))"))
    plain = "x.front RLIKE '\\\\A[A-Za-z]' AND NOT (right(x.front, 1) IN ('\"', '\\'', '`') AND left(x.c.after, 1) = right(x.front, 1))"
    d = d.withColumn("found", F.expr(f"transform(found, x -> named_struct('c', x.c, 'front', x.front, 'v', CASE WHEN {plain} THEN coalesce(nullif(rtrim('{quoted(CLOSING)}', x.v), ''), x.v) ELSE x.v END))"))
    d = d.withColumn("found", F.expr("transform(found, x -> named_struct('c', x.c, 'front', x.front, 'v', x.v, 'rest', substr(x.c.v, length(x.front) + length(x.v) + 1)))"))
    d = d.withColumn("found_gaps", F.expr("transform(found_gaps, (g, k) -> concat(coalesce(CASE WHEN k > 0 THEN found[k - 1].rest END, ''), g, coalesce(CASE WHEN k < size(found) THEN found[k].front END, '')))"))
    around = f"'before', right(concat(x.c.before, x.front), {AROUND}), 'after', left(concat(x.rest, x.c.after), {AROUND})"
    d = d.withColumn("found", F.expr(f"transform(found, x -> named_struct('v', x.v, 'start', x.c.start + length(x.front), 'end', x.c.start + length(x.front) + length(x.v), 'front', x.front, {around}, 'path', coalesce(source, '')))"))
    return d.withColumn("found", F.expr("transform(found, c -> named_struct('v', c.v, 'start', c.start, 'end', c.end, 'f', array(" + ", ".join(FEATURES) + ")))"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(text, source, label) made by rule; each text has its labelled candidate last but for ``tail``."""
    rows = spark.range(n, numPartitions=1).selectExpr("id", "sha2(concat('a', id), 512) AS x", "sha2(concat('b', id), 256) AS y", "id % 46 AS kind", "id div 46 AS k")
    b64 = "base64(unhex(substr(x, 1, {n})))"
    upper = "upper(translate(substr(x, 1, 16), '0189', 'QRST'))"
    word = "element_at(array('password', 'passwd', 'PASSWORD', 'db_password', 'secret', 'api_key', 'pwd'), 1 + cast(conv(substr(y, 13, 4), 16, 10) % 7 as int))"
    human = "element_at(array('hunter', 'dragon', 'sommer', 'Passw0rd', 'letmein', 'qwerty', 'soleil'), 1 + cast(conv(substr(y, 17, 4), 16, 10) % 7 as int))"
    link = "element_at(array('=', ': ', ' = ', ':'), 1 + cast(conv(substr(y, 21, 4), 16, 10) % 4 as int))"
    quote = "CASE WHEN conv(substr(y, 25, 2), 16, 10) % 2 = 0 THEN '' ELSE '\"' END"
    noun = lambda at: f"element_at(array('horse', 'river', 'purple', 'cake', 'winter', 'battery', 'blue', 'garden'), 1 + cast(conv(substr(y, {at}, 4), 16, 10) % 8 as int))"
    mark = "element_at(array(',', ';', '&', '=', ',&', '!,', '@', '+'), 1 + cast(conv(substr(y, 41, 4), 16, 10) % 8 as int))"
    letters = "substr(translate(x, '0123456789abcdef', 'ertionshadlumcgi'), 1, 12 + cast(k % 9 as int))"
    value = f"""CASE kind
        WHEN 0 THEN concat('AKIA', {upper})
        WHEN 1 THEN concat('token = "', substr(x, 1, 40), '"')
        WHEN 2 THEN concat('password=', substr(x, 1, 18))
        WHEN 3 THEN concat('api_key: "', {b64.format(n=48)}, '"')
        WHEN 4 THEN concat('ghp_', translate(substr(x, 1, 36), '02468', 'KpQzW'))
        WHEN 5 THEN concat('secret = \\'', {b64.format(n=40)}, '\\'')
        WHEN 6 THEN concat('sk_live_', translate(substr(x, 1, 24), '13579', 'gHjKm'))
        WHEN 7 THEN concat('password=', substr(x, 1, 4), '!', substr(y, 1, 6), '#Q')
        WHEN 8 THEN concat('AWS_SECRET_ACCESS_KEY=', {b64.format(n=60)})
        WHEN 9 THEN concat('auth token: ', substr(x, 1, 32))
        WHEN 10 THEN concat('commit ', substr(x, 1, 40))
        WHEN 11 THEN concat('sha256: ', substr(x, 1, 64))
        WHEN 12 THEN concat('order number ', translate(substr(x, 1, 16), 'abcdef', '123456'))
        WHEN 13 THEN concat('uuid=', substr(x, 1, 8), '-', substr(x, 9, 4), '-', substr(x, 13, 4), '-', substr(x, 17, 4), '-', substr(x, 21, 12))
        WHEN 14 THEN concat('password=', element_at(array('changeme', '<your-password>', 'example_password', '${{DB_PASSWORD}}', 'xxxxxxxxxxxx'), 1 + cast(k % 5 as int)))
        WHEN 15 THEN element_at(array('administrations', 'international', 'ununterbrochen', 'responsabilidades', 'environnementales', 'straightforward', 'thononsthatinger'), 1 + cast(k % 7 as int))
        WHEN 16 THEN concat(translate(substr(x, 1, 16), 'abcdef', '123456'))
        WHEN 17 THEN concat('the-', element_at(array('quick-brown-fox', 'state-of-the-art', 'well_known_function_name', 'src/main/java/com/example'), 1 + cast(k % 4 as int)))
        WHEN 18 THEN concat('md5 = "', substr(x, 1, 32), '"')
        WHEN 19 THEN concat({word}, ': ', {human}, substr(y, 1, 1 + cast(k % 4 as int)))
        WHEN 20 THEN concat('token=', substr(x, 1, 32))
        WHEN 21 THEN concat({word}, {link}, {quote}, {human}, element_at(array('!', '#', '$', '%', '_'), 1 + cast(k % 5 as int)), substr(y, 1, 3), {quote})
        WHEN 22 THEN concat({word}, element_at(array(': required', ': string', '=none12', ' = \\'hidden\\'', ': optional', '=<hidden>', ' = disabled'), 1 + cast(k % 7 as int)))
        WHEN 23 THEN concat(element_at(array('the ', '. ', '| ', 'of. '), 1 + cast(k % 4 as int)), CASE WHEN k % 3 = 0 THEN {letters} ELSE initcap({letters}) END)
        WHEN 24 THEN concat('card ', translate(substr(x, 1, 4), 'abcdef', '123456'), '-', translate(substr(x, 5, 4), 'abcdef', '123456'), '-', translate(substr(x, 9, 4), 'abcdef', '123456'))
        WHEN 26 THEN concat({word}, {link}, '"', {noun(29)}, ' ', {noun(33)}, ' ', CASE WHEN k % 4 = 0 THEN '' ELSE substr(y, 45, 2) END, ' ', {noun(37)}, '"')
        WHEN 27 THEN concat({word}, {link}, substr(x, 1, 5), {mark}, upper(substr(x, 6, 3)), substr(x, 9, 4))
        WHEN 28 THEN concat(element_at(array('postgres', 'https', 'amqp', 'mysql+driver', 'redis'), 1 + cast(k % 5 as int)), '://', {noun(29)}, ':', CASE WHEN k % 3 = 0 THEN {human} ELSE upper(substr(x, 6, 3)) END, '#', substr(x, 1, 4), '@db/x')
        WHEN 29 THEN concat('https://user:', element_at(array('password', '<password>', '${{PASSWORD}}', '$PASSWORD', '{{password}}', 'xxxxxx', '********'), 1 + cast(k % 7 as int)), '@host/x')
        WHEN 30 THEN concat({word}, {link}, '"', element_at(array('must not be empty', 'please enter your password', 'the name of the field', 'a string to sign with', 'is required for this', 'not found', 'wrong or missing', 'at least eight characters'), 1 + cast(k % 8 as int)), '"')
        WHEN 31 THEN concat({word}, {link}, element_at(array('os.environ["DB_PASS"]', 'get_token()', 'self.secret_value', 'config.password', 'settings.API_KEY', 'request.form["password"]', 'getpass.getpass()', 'args.token'), 1 + cast(k % 8 as int)))
        WHEN 32 THEN concat({word}, {link}, '"', substr(x, 1, 3), {mark}, upper(substr(x, 6, 4)), {mark}, substr(x, 10, 5), '"')
        WHEN 33 THEN concat({word}, ': ', element_at(array('https://host/reset', 'http://docs/tokens.html', '/etc/app/passwords', './keys/readme.md'), 1 + cast(k % 4 as int)))
        WHEN 34 THEN concat('href="/', element_at(array('articles', 'category', 'download'), 1 + cast(k % 3 as int)), '/', substr(translate(x, '0123456789', 'ghijklmnop'), 1, 9), '"')
        ELSE concat(element_at(array('the ', '. ', '| ', '### '), 1 + cast(k % 4 as int)), CASE WHEN kind % 3 = 0 THEN initcap({letters}) WHEN kind = 40 THEN upper({letters}) ELSE {letters} END) END"""
    lead = "element_at(array('of the reand and ', 'est le tion. ', 'und der ', 'los que\n', 'export ', '', 'see ', '*** '), 1 + cast(conv(substr(y, 1, 4), 16, 10) % 8 as int))"
    tail = "element_at(array(' the and of', '', '\n', ' ist von', '### est'), 1 + cast(conv(substr(y, 5, 4), 16, 10) % 5 as int))"
    source = "element_at(array('src1', 'src7', '', 'config/app.yml', '.env', 'lib/util.py', 'docs/readme.md'), 1 + cast(conv(substr(y, 9, 4), 16, 10) % 7 as int))"
    return rows.selectExpr(f"concat({lead}, {value}, {tail}) AS text", f"{source} AS source", "CAST(kind < 10 OR kind BETWEEN 19 AND 21 OR kind BETWEEN 26 AND 28 OR kind = 32 AS DOUBLE) AS label")


def train(spark: SparkSession, findings: DataFrame | None = None) -> str:
    """A forest fitted to labelled findings (text, source, label), as SQL over a struct c with c.f."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    # written between the steps: fitting passes over the rows many times
    made = written(findings if findings is not None else labelled_findings(spark), "labelled")
    rows = written(with_candidates(made).select("label", F.explode("found").alias("c")), "findings")
    rows = rows.select("label", array_to_vector("c.f").alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    return tree_sql.forest_probability(forest.fit(rows.coalesce(1)), "c.f")


def scan(documents: DataFrame, vote: str | None = None) -> DataFrame:
    """The columns text, source and any others with ``found_gaps`` (the texts between candidates) and
    ``found``: every candidate's place, votes and verdict."""
    vote = vote or train(documents.sparkSession)
    d = with_candidates(documents)
    d = d.withColumn("found", F.expr(f"transform(found, c -> named_struct('start', c.start, 'end', c.end, 'value', c.v, 'votes', {vote}))"))
    return d.withColumn("found", F.expr(f"transform(found, c -> named_struct('start', c.start, 'end', c.end, 'value', c.value, 'votes', c.votes, 'secret', c.votes >= {VOTES}D))"))


def redact(documents: DataFrame, vote: str | None = None) -> DataFrame:
    """The documents, all rows and columns as given, with every secret replaced in the text."""
    names = documents.columns
    source = F.col("source").cast("string") if "source" in names else F.lit("")
    # the rows as given are one column, apart from the operator's own
    d = scan(documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").cast("string").alias("text"), source.alias("source")), vote)
    joined = F.expr(f"concat(found_gaps[0], array_join(transform(found, (c, k) -> concat(CASE WHEN c.secret THEN '{REPLACEMENT}' ELSE c.value END, found_gaps[k + 1])), ''))")
    text = F.when(F.expr("exists(found, c -> c.secret)"), joined).otherwise(F.col("text"))
    return d.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names))


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    d = scan(docs).select("doc_id", F.explode_outer("found").alias("c"))
    return d.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"), F.round("c.votes", 6).alias("votes"), F.coalesce("c.secret", F.lit(False)).alias("secret"), F.sha2("c.value", 256).alias("value_sha256"))
