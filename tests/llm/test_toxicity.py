import random
import zlib

from lodeseek.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, toxic string", "doc_id long, quality int, toxic int"


LEXICON = T.Lexicon({"idiot": 2.0}, {"blork": 1.5})
WEIGHTS = {T.TARGETED: 1.3, T.NEGATED: 0.25, T.REPORTED: 0.5, T.THREATENING: 2.0}


def brute_force(text):
    """(clause, word, weight) of every match, context by context over the words of its clause."""
    words = T.TOKEN.findall(text.lower())
    symbols = [LEXICON(w) for w in words]
    out, start, clause, quoted, reporting = [], 0, 0, False, False
    for i, (symbol, own) in enumerate(symbols):
        before = [s for s, _ in symbols[start:i]]
        targeted, threat = T.TARGET in before, T.THREAT in before
        if symbol == T.INSULT or (symbol == T.THREAT and targeted) or (symbol == T.TARGET and threat):
            since = before[::-1].index(T.NEGATION) if T.NEGATION in before else None
            negated = since is not None and sum(s in (T.OTHER, T.INSULT, T.THREAT) for s in before[len(before) - since :]) < T.REACH
            for holds, context in ((targeted, T.TARGETED), (negated, T.NEGATED), (reporting, T.REPORTED), (threat, T.THREATENING)):
                own *= WEIGHTS[context] if holds else 1
            out.append((clause, words[i], own))
        if symbol == T.END:
            start, clause = i + 1, clause + 1
            reporting = reporting and quoted
        elif symbol == T.REPORT:
            reporting = True
        elif symbol == T.QUOTE:
            quoted, reporting = not quoted, reporting and not quoted
    return out


def test_machine_equals_brute_force():
    rng, machine = random.Random(11), T.grammar(WEIGHTS)
    parts = ["you", "idiot", "BLORKED", "blor", "kill", "not", "never", "said", '"', ".", "\n", "walks", "the", "they", "wrote", "7", ","]
    seen = 0
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 25)))
        got = [(c, w, x) for c, w, x, _ in T.matches(text, LEXICON, machine)]
        want = brute_force(text)
        assert [g[:2] for g in got] == [w[:2] for w in want], text
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True)), text
        seen += len(want)
    assert seen > 3000


def test_clauses_are_scored():
    at = lambda text: T.features(text, LEXICON, T.grammar(WEIGHTS))[1]
    assert at("you are an idiot") > at("an idiot walks") > at('they said "what an idiot"') > at("he is not an idiot") > at("") == 0
    assert at("never. an idiot") == at("an idiot")
    assert at("i will kill you") > at("you will kill") > 0
    assert at("i will kill time") == at("") and at("you. i will kill") == at("")


def test_composition_multiplies():
    machine = T.grammar(WEIGHTS)
    state = 0
    for symbol in (T.TARGET, T.NEGATION, T.REPORT):
        state = machine.step[state][symbol]
    assert machine.contexts[state] == {T.TARGETED, T.NEGATED, T.REPORTED}
    assert machine.match[state][T.INSULT] and abs(machine.weight[state][T.INSULT] - 1.3 * 0.25 * 0.5) < 1e-12
    assert machine.step[state][T.END] == 0


def test_weights_of_contexts_are_learned(spark):
    rows = [("you idiot here", 1)] * 40 + [("this is not an idiot", 0)] * 40 + [("an idiot", 1)] * 5 + [("an idiot", 0)] * 5
    weights = T.learn_weights(spark.createDataFrame(rows, "text string, toxic int"), LEXICON)
    assert weights[T.TARGETED] > 1.3 and weights[T.NEGATED] < 0.4 and weights[T.REPORTED] == weights[T.THREATENING] == 1


def corpus(n=600):
    rng = random.Random(3)
    words = [a + b for a in "ka lo mi tu re so".split() for b in "na pe di vo gu".split()]
    docs, labels = [(0, None, "x"), (1, "", "x")], []
    for i in range(2, n):
        toxic = rng.random() < 0.25
        own = rng.choices(words, k=rng.randint(10, 60))
        if toxic:
            for _ in range(2):
                own[rng.randrange(len(own))] = rng.choice(["zarbo", "quell" + rng.choice(words)])
        docs.append((i, " ".join(own), "x"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
        docs[-1] = (*docs[-1][:2], str(int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    model = T.train(frame, spark.createDataFrame([*labels, (5, 1, 0), (5, 1, 1), (None, 1, 1)], LABELS))
    truth = {i: t for i, _, t in docs if t != "x"}
    right = [(r.score >= T.THRESHOLD) == (truth[r.doc_id] == "1") for r in T.score(frame, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    kept = T.keep_clean(frame, model)
    assert kept.columns == frame.columns
    assert {0, 1} <= {r.doc_id for r in kept.collect()}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot", "a"), (2, "fine", None), (2, "fine", None)], DOCS)
    model = T.train(docs, spark.createDataFrame([], LABELS))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert got[1] > 0.3 > got[2]
    assert T.score(spark.createDataFrame([], DOCS), model).collect() == []
