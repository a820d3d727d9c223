"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reporting, quotation mark, end of clause, or
other.  Small weighted transducers read the symbols: one matches insults, one threats with a target
before or after them; the others match nothing but weigh what is matched while a target was named, a
negation is near, speech is reported or a threat is under way.  They are composed into one machine, in
which weights multiply along an arc.  A match has the weight of its arc times that of its word, a
clause the sum of its matches, and the document's score is a logistic function of its clauses.

The lexicon of insults (whole words, and stems where a language makes many forms of one), the
transducers' weights (how much likelier a match is toxic within the context than outside it) and the
logistic function are learned from labels of training documents: a bounded sample of them, TRAIN_ROWS.
One of several near copies counts once there.  Nothing but the text enters a score.

Defined results: null and empty texts match nothing and get the score of a text without matches; a
doc_id that is labelled twice with different labels is no training row; without training rows of
both kinds the lexicon is the seed list and the weights are 1; repeated rows are scored each; a text
of any length is scored whole; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_kernels as K

#: Labelled documents that the lexicon and the weights are learned from, at most; by hash of doc_id.
TRAIN_ROWS = 24_000
#: Documents with a word or stem, and share of toxic ones among them, from which it enters the lexicon.
LEAST_DOCS, LEAST_SHARE = 6, 0.9
STEM_LENGTHS = range(3, 9)
THRESHOLD = 0.3
HELD_OUT = (4, 2)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”«»„]")

# Symbols and seed words of the grammar: fixed values.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
SEED = {
    INSULT: "idiot moron stupid scum loser trash worthless pathetic imbecile dumbass bastard",
    THREAT: "kill hurt destroy beat stab shoot strangle burn punch töten umbringen tuer frapper matar golpear",
    TARGET: "you your yourself u he she they them these those du dich dein ihr sie tu toi vous te tes votre usted ustedes ellos",
    NEGATION: "not never no isn aren wasn don doesn nicht kein keine nie pas jamais ne nunca jamás",
    REPORT: "said says say wrote writes called calls quoted claims claimed reported sagte sagt schrieb dit disait écrit dijo dice escribió",
    QUOTE: '" “ ” « » „',
    END: ". ! ? ; \n",
}
SEED_SYMBOLS = {w: symbol for symbol, words in SEED.items() for w in (words.split(" ") if symbol in (QUOTE, END) else words.split())}
#: Words after a negation that it still reaches.
REACH = 3
#: Contexts that weigh a match.
TARGETED, NEGATED, REPORTED, THREATENING = CONTEXTS = range(4)
#: Bounds of a context's weight.
WEIGHTS = (0.05, 4.0)
N_FEATURES = 6


class Transducer:
    """A complete deterministic weighted transducer: from a state a symbol leads to step[state][symbol]
    on an arc of weight[state][symbol]; match[state][symbol] tells whether the arc writes a match, and
    contexts[state] what a match from there stands in."""

    def __init__(self, step: list[list[int]], weight: list[list[float]], match: list[list[bool]], contexts: list[frozenset]):
        self.step, self.weight, self.match, self.contexts = step, weight, match, contexts

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols: weights multiply, a match of either is one.  Only reachable
        states are made."""
        names, todo, step, weight, match, contexts = {(0, 0): 0}, [(0, 0)], [], [], [], []
        for a, b in todo:
            row = []
            for symbol in range(END + 1):
                pair = (self.step[a][symbol], other.step[b][symbol])
                if pair not in names:
                    names[pair] = len(names)
                    todo.append(pair)
                row.append(names[pair])
            step.append(row)
            weight.append([x * y for x, y in zip(self.weight[a], other.weight[b], strict=True)])
            match.append([x or y for x, y in zip(self.match[a], other.match[b], strict=True)])
            contexts.append(self.contexts[a] | other.contexts[b])
        return Transducer(step, weight, match, contexts)


def _matcher(states: int, moves, matches) -> Transducer:
    step = [[moves(s, symbol) for symbol in range(END + 1)] for s in range(states)]
    return Transducer(step, [[1.0] * (END + 1)] * states, [[matches(s, symbol) for symbol in range(END + 1)] for s in range(states)], [frozenset()] * states)


def _context(context: int, inside: set[int], states: int, moves, weights: dict[int, float]) -> Transducer:
    """Arcs from the states ``inside`` have the context's weight."""
    step = [[moves(s, symbol) for symbol in range(END + 1)] for s in range(states)]
    weight = [[weights.get(context, 1.0) if s in inside else 1.0] * (END + 1) for s in range(states)]
    return Transducer(step, weight, [[False] * (END + 1)] * states, [frozenset([context] if s in inside else ()) for s in range(states)])


def grammar(weights: dict[int, float] | None = None) -> Transducer:
    """Insults and threats, composed with target, negation, reported speech and threat as contexts."""
    weights = weights or {}
    insult = _matcher(1, lambda s, x: 0, lambda s, x: x == INSULT)
    # bit 0: a target was named in the clause, bit 1: a threat
    threat = _matcher(4, lambda s, x: 0 if x == END else s | (x == TARGET) | (x == THREAT) << 1, lambda s, x: (x == THREAT and s & 1 > 0) or (x == TARGET and s & 2 > 0))
    target = _context(TARGETED, {1}, 2, lambda s, x: 0 if x == END else 1 if x == TARGET else s, weights)
    negation = _context(NEGATED, set(range(1, REACH + 1)), REACH + 1, lambda s, x: 0 if x == END else REACH if x == NEGATION else max(0, s - (x in (OTHER, INSULT, THREAT))), weights)
    # reporting opens; an end of clause closes it, but not within quotation marks
    report = _context(REPORTED, {1, 3}, 4, lambda s, x: {END: {1: 0}, REPORT: {0: 1, 2: 3}, QUOTE: {0: 2, 1: 3, 2: 0, 3: 0}}.get(x, {}).get(s, s), weights)
    under_way = _context(THREATENING, {1}, 2, lambda s, x: 0 if x == END else 1 if x == THREAT else s, weights)
    return insult.compose(threat).compose(target).compose(negation).compose(report).compose(under_way)


class Lexicon:
    """Weights of words and stems; a word is what it is in whole, else by its longest stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.memo = words, stems, {}

    def __call__(self, word: str) -> tuple[int, float]:
        found = self.memo.get(word)
        if found is None:
            found = self._look(word)
            if len(self.memo) < 400_000:
                self.memo[word] = found
        return found

    def _look(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in reversed(STEM_LENGTHS):
            if len(word) > n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return SEED_SYMBOLS.get(word, OTHER), 1.0

    def __getstate__(self):
        return self.words, self.stems

    def __setstate__(self, state):
        self.__init__(*state)


def matches(text: str, lexicon: Lexicon, machine: Transducer):
    """The matches of a text: clause, word, weight and contexts of each."""
    words = TOKEN.findall(text.lower())
    symbols = [lexicon(w) for w in words]
    if not any(s == INSULT or s == THREAT for s, _ in symbols):
        return
    step, weight, match = machine.step, machine.weight, machine.match
    state, clause = 0, 0
    for (symbol, own), word in zip(symbols, words, strict=True):
        if match[state][symbol]:
            yield clause, word, own * weight[state][symbol], machine.contexts[state]
        clause += symbol == END
        state = step[state][symbol]


def features(text: str, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """What the clauses of a text matched: their weights together, the heaviest one, their number,
    whether there is more than one match, and how many different words match."""
    clauses: dict[int, float] = {}
    matched: list[str] = []
    for clause, word, weight, _ in matches(text, lexicon, machine):
        clauses[clause] = clauses.get(clause, 0.0) + weight
        matched.append(word)
    return [1.0, math.log1p(sum(clauses.values())), math.log1p(max(clauses.values(), default=0.0)), math.log1p(len(clauses)), float(len(matched) > 1), math.log1p(len(set(matched)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge * max(1, len(y)) / 100] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1]


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most TRAIN_ROWS labelled training documents, one of several near copies."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    chosen = known.where("toxic = other").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    rows = docs.join(F.broadcast(chosen), "doc_id").mapInArrow(_with_print, "doc_id long, text string, toxic int, print long")
    return rows.groupBy("print", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "toxic")


def _with_print(batches):
    """The least hash of a text's shingles, the same for most near copies."""
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(1))
        prints = []
        for i, j, s, at in K.spaced_shingles(data, offsets, 5):
            prints += [int(s[at[d] : at[d + 1]].min()) if at[d + 1] > at[d] else 0 for d in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "text", "toxic", "print"])


def _counts(batches):
    """Training documents with each word (kind 0) and stem (kind 1), by label, of a batch."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {w for w in TOKEN.findall(text.lower()) if w not in SEED_SYMBOLS or SEED_SYMBOLS[w] == INSULT}
            counts[toxic].update(own | {(w[:n],) for w in own for n in STEM_LENGTHS if len(w) > n})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k if isinstance(k, str) else k[0] for k in keys], pa.string()), pa.array([int(not isinstance(k, str)) for k in keys], pa.int32()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            names=["token", "kind", "toxic", "clean"],
        )


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems that toxic training documents have and clean ones hardly have."""
    found = rows.mapInArrow(_counts, "token string, kind int, toxic long, clean long").groupBy("token", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = found.where((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    found = found.collect()  # words of the sample, TRAIN_ROWS texts at most
    weight = lambda r: math.log((r.toxic + 0.5) / (r.clean + 0.5))
    lexicon = Lexicon({r.token: weight(r) for r in found if not r.kind}, {r.token: weight(r) for r in found if r.kind})
    if not found:
        lexicon = Lexicon({w: 1.0 for w in SEED[INSULT].split()}, {})
    return lexicon


def _contexts_seen(batches, lexicon: Lexicon, machine: Transducer):
    """Matches by context, whether they stand in it, and label; of a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for *_, contexts in matches(text or "", lexicon, machine):
                counts.update((c, c in contexts, toxic) for c in CONTEXTS)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["context", "inside", "toxic", "n"])


def learn_weights(rows: DataFrame, lexicon: Lexicon) -> dict[int, float]:
    """Per context the share of toxic matches within it over that outside it."""
    found = rows.mapInArrow(partial(_contexts_seen, lexicon=lexicon, machine=grammar()), "context int, inside boolean, toxic int, n long")
    n = {(r.context, r.inside, r.toxic): r.n for r in found.groupBy("context", "inside", "toxic").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for c in CONTEXTS:
        # drawn to the share of all matches by ten of them
        every = sum(n.get((c, x, 1), 0) for x in (True, False)) / max(1, sum(n.get((c, x, t), 0) for x in (True, False) for t in (0, 1)))
        share = {x: (n.get((c, x, 1), 0) + 10 * every) / (n.get((c, x, 0), 0) + n.get((c, x, 1), 0) + 10) for x in (True, False)}
        out[c] = min(max(share[True] / share[False], WEIGHTS[0]), WEIGHTS[1]) if share[False] else 1.0
    return out


def _featured(batches, lexicon: Lexicon, machine: Transducer):
    for batch in batches:
        x = [features(t or "", lexicon, machine) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "toxic"])


class Model:
    def __init__(self, lexicon: Lexicon, contexts: dict[int, float], weights: np.ndarray):
        self.lexicon, self.contexts, self.weights, self.machine = lexicon, contexts, weights, grammar(contexts)

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, features(text or "", self.lexicon, self.machine)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    from .storage import written

    rows = written(training_rows(documents, labels), "training")
    lexicon = learn_lexicon(rows)
    contexts = learn_weights(rows, lexicon)
    got = rows.mapInArrow(partial(_featured, lexicon=lexicon, machine=grammar(contexts)), "x array<double>, toxic int").collect()  # TRAIN_ROWS at most
    x, y = np.array([r.x for r in got] or [[1.0] + [0.0] * (N_FEATURES - 1)]), np.array([r.toxic for r in got] or [0], float)
    if 0 < y.sum() < len(y):
        weights = fit_logistic(x, y)
    else:
        weights = np.array([-3.0, 2.0, 0.5, 0.5, 0.5, 0.5])
    return Model(lexicon, contexts, weights)


def _scored(batches, sent):
    model = sent.value
    for batch in batches:
        scores = [model.score(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(partial(_scored, sent=sent), "doc_id long, score double")


def _kept(batches, sent, at: int):
    model = sent.value
    for batch in batches:
        yield batch.filter(pa.array([model.score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(partial(_kept, sent=sent, at=documents.columns.index("text")), documents.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
