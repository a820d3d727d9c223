"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model interpolates trigrams, bigrams and words over words and an end token, with h1 the token
before w and h2 the one before that (or the beginning):

    p1(w)        = (c(w) + 1) / (N + V + 1)
    p(w | h2 h1) = (c(h2 h1 w) + b c(h1 w) + m p1(w)) / (c(h2 h1) + b c(h1) + m)

It sums to 1 over the vocabulary and one unknown word.  b and m are those of SHARES and MASSES with the
highest leave-one-out likelihood of the training tokens, by the counts of all of them.  Scores depend on
the table alone, not on files, partitions or batches.

A chunk of documents has its distinct n-grams in reversed order as a trie: words, pairs (a word and the h1
before it, hashed together) and below each pair the h2 before both, every level one Elias-Fano sequence.  It
is cut by ranges of the hashes and dealt to the shards, each n-gram once with its count in the chunk; no word is
hot, for its pairs are spread.  A shard adds up what was learned into its own trie - again Elias-Fano sequences,
memory-mapped, with the counts beside - asks it for every n-gram of every chunk by successor search, and
hands the counts back, in the chunk's order.  There they meet the tokens of the chunk, read a second time, and
give each document's score for every b and m and the chunk's part of the likelihood, so that what was dealt is
read once.  The model's tables are never gathered anywhere; a shard is rebuilt from its input if its
executor is lost.  Should the second reading give other tokens than the first, the job fails.

Defined results: null and empty texts are the one end token; without training rows every word is
unknown; repeated rows are scored each, by their own text, of any length; a null doc_id counts as the empty text
for the split; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_kernels as K
from .blobs import pack, unpack
from .elias_fano import EliasFano, decoded, encoded, mapped
from .storage import written

U = np.uint64
#: Weights that the bigram's and the word's level may have, as seen tokens: b and m.
SHARES, MASSES = [1 / 64, 1 / 8, 1.0], [4.0**k for k in range(0, 11, 2)]
GRID = [(b, m) for b in SHARES for m in MASSES]
#: Has no effect any more: frequent words were dealt apart when a word's n-grams lay in one shard.
HOT = 50_000
#: Bytes of text meant for one shard.
PER_SHARD = 20_000_000
#: Tokens of a chunk, which a task holds at a time.
CHUNK_TOKENS = 1_300_000
#: Ranges of pairs in which a shard builds and asks its trie, one after another, to hold less.
RANGES = 4
#: One of so many pairs of words counts for b and m: every one.
PAIR_SHARE = 1
#: Bits of the hashes of pairs and of the h2 below a pair; words have 64.
PAIR_BITS, CONTEXT_BITS = 56, 36
#: Steps of quantised values; counts are kept as they are.
QUANTUM = 1 / 2048
HELD_OUT = (7, 2)
END, BEGIN = U(0x8E9D5AAB3C1F2467), U(0x1B873593CC9E2D51)

BLOBS = "shard int, batch long, digest long, words binary, pairs binary, grams binary, counts binary"
ANSWERS = "shard int, batch long, digest long, counts binary, total long, vocabulary long, docs long"
CHUNKS = "batch long, digest long, words binary, tokens binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, fit array<double>"


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % HELD_OUT[0] == HELD_OUT[1] for i in ids], bool)


def _tokens(batch: pa.RecordBatch):
    """Per block of documents: first row, last row, token hashes, offsets; each document ends with END."""
    data, offsets = K.text_bytes(batch.column(1))
    for i, j in K.blocks(offsets, K.BLOCK):
        part = K.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = K.words(part, offsets[i : j + 1] - offsets[i], K.IS_WORD_SPACED)
        out = np.full(len(starts) + j - i, END, U)
        out[np.arange(len(starts)) + np.repeat(np.arange(j - i), np.diff(first))] = K.word_hashes(part, starts, ends)
        yield i, j, out, first + np.arange(j - i + 1)


class Grams:
    """The distinct n-grams of documents of these sizes, one after another.  ``words`` are hashes in order and
    ``word`` each token's; ``pairs`` hashes of (w, h1) in order; ``grams`` in order hold a pair's index
    above CONTEXT_BITS of h2, and ``gram`` is each token's."""

    def __init__(self, words: np.ndarray, word: np.ndarray, sizes: np.ndarray):
        self.words, self.word = words, word
        tokens, start = words[word], np.cumsum(sizes) - sizes
        h1, h2 = np.empty_like(tokens), np.empty_like(tokens)
        h1[1:], h2[2:] = tokens[:-1], tokens[:-2]
        h1[start] = h2[start] = BEGIN
        h2[start[sizes > 1] + 1] = BEGIN
        # in place, for these are the largest arrays that a task holds
        h1 *= K.STEP
        h1 ^= tokens
        del tokens
        h1 = K.mix(h1)
        h1 >>= U(64 - PAIR_BITS)
        self.pairs, pair = np.unique(h1, return_inverse=True)
        del h1
        self.pair_word = np.empty(len(self.pairs), np.int64)
        self.pair_word[pair] = word
        h2 >>= U(64 - CONTEXT_BITS)
        h2 |= pair.astype(U) << U(CONTEXT_BITS)
        del pair
        self.grams, self.gram = np.unique(h2, return_inverse=True)

    def pair(self) -> np.ndarray:
        """Each n-gram's pair."""
        return (self.grams >> U(CONTEXT_BITS)).astype(np.int64)


def _chunks(batches):
    """Per chunk: the place of its first row in the table, digest, ids, whether held out, tokens of each document,
    words and each token's word."""
    from pyspark import TaskContext

    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def whole(first, last, parts, sizes):
        hashes = np.concatenate(parts)
        digest = int((hashes * (np.arange(len(hashes), dtype=U) * U(2) + U(1))).sum().view(np.int64))
        return row + first, digest, ids[first:last], _held_out(ids[first:last]), np.concatenate(sizes), *np.unique(hashes, return_inverse=True)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        parts, sizes, total, first = [], [], 0, 0
        for i, _, t, at in _tokens(batch):
            if parts and total + len(t) > CHUNK_TOKENS:
                yield whole(first, i, parts, sizes)
                parts, sizes, total, first = [], [], 0, i
            parts.append(t)
            sizes.append(np.diff(at))
            total += len(t)
        if parts:
            yield whole(first, batch.num_rows, parts, sizes)
        row += batch.num_rows


def _bounds(shards: int) -> np.ndarray:
    """Where each shard's range of 64-bit hashes begins; the first at 0."""
    return np.array([-(-(k << 64) // shards) for k in range(shards)], dtype=U)


def _dealt(batches, shards: int):
    """Every chunk's trie, cut for the shards, with the training tokens of each word and trigram."""
    of_words = _bounds(shards)
    of_pairs = of_words >> U(64 - PAIR_BITS)
    for batch, digest, _, held, sizes, words, word in _chunks(batches):
        learn = np.repeat(~held, sizes)
        g = Grams(words, word, sizes)
        seen_word = np.bincount(word[learn], minlength=len(words)).astype(np.uint32)
        seen = np.bincount(g.gram[learn], minlength=len(g.grams)).astype(np.uint32)
        w, p = (np.append(np.searchsorted(x, b), len(x)) for x, b in ((words, of_words), (g.pairs, of_pairs)))
        t = np.append(np.searchsorted(g.grams, p[:-1].astype(U) << U(CONTEXT_BITS)), len(g.grams))
        full = np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0))
        blobs: list[list[bytes]] = [[], [], [], []]
        for s in full:
            blobs[0].append(encoded(words[w[s] : w[s + 1]] - of_words[s], (1 << 64) // shards))
            blobs[1].append(encoded(g.pairs[p[s] : p[s + 1]] - of_pairs[s], (1 << PAIR_BITS) // shards))
            blobs[2].append(encoded(g.grams[t[s] : t[s + 1]] - (U(p[s]) << U(CONTEXT_BITS)), int(p[s + 1] - p[s]) << CONTEXT_BITS))
            blobs[3].append(pack([np.concatenate([seen_word[w[s] : w[s + 1]], seen[t[s] : t[s + 1]]])]))
        n = len(full)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array([digest] * n, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], names=_fields(BLOBS))


class Level:
    """One level of a trie: the children of nodes, with their values.  An element of its sequence is the
    node above the id, so that a node's children are one run."""

    def __init__(self, node: np.ndarray, ids: np.ndarray, values: np.ndarray, nodes: int, universe: int):
        """Children sorted by node and id; whole values are kept as they are, others in steps of QUANTUM."""
        self.universe, self.exact = U(universe), values.dtype.kind in "iu"
        self.ids = EliasFano(node.astype(U) * self.universe + ids.astype(U), max(nodes, 1) * universe)
        self.values = mapped(values if self.exact else quantised(values))

    def find(self, node: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of children with these ids under these nodes; -1 where there are none."""
        out = np.full(len(node), -1)
        live = node >= 0
        out[live] = self.ids.find(node[live].astype(U) * self.universe + ids[live].astype(U))
        return out

    def value(self, place: np.ndarray) -> np.ndarray:
        found = _values(self.values, place)
        return found if self.exact else found * QUANTUM


def _values(stored: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The values at these places, 0 at -1."""
    return np.where(place >= 0, stored[np.maximum(place, 0)], 0) if len(stored) else np.zeros(len(place), stored.dtype)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x / QUANTUM), -(1 << 31), (1 << 31) - 1).astype(np.int32)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, with the sums of their counts; what has no count is left out."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


class Root:
    """The level of n-grams given by their hashes alone, with their counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, universe: int):
        keys, sums = _added(hashes, counts)
        self.ids, self.values = EliasFano(keys, universe), mapped(sums)


class _Shard:
    """What was dealt to a shard."""

    def __init__(self, batches):
        self.of, self.words, self.pairs, self.grams, self.seen_words, self.seen = [], [], [], [], [], []
        for batch in batches:
            for shard, chunk, digest, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, pairs, grams = (decoded(b) for b in blobs[:3])
                (counts,) = unpack(blobs[3], [np.uint32])
                self.of.append((shard, chunk, digest))
                for held, x in zip((self.words, self.pairs, self.grams, self.seen_words, self.seen), (words, pairs, grams, counts[: len(words)], counts[len(words) :]), strict=True):
                    held.append(x)

    def word_counts(self, end: int) -> tuple[list[np.ndarray], int, int, int]:
        """The count of every word of every chunk; tokens, distinct words and documents (``end``: the end's hash
        here) of all."""
        every = np.concatenate(self.words)
        level = Root(every, np.concatenate(self.seen_words).astype(np.int64), 1 << 64)
        answers = _values(level.values, level.ids.find(every))
        docs = _values(level.values, level.ids.find(np.array([end], U)))
        return np.split(answers, np.cumsum([len(x) for x in self.words])[:-1]), int(level.values.sum()), level.ids.n, int(docs[0])

    def gram_counts(self) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
        """The counts of every pair and of every trigram of every chunk, in pieces by range of pairs."""
        top = int(max(p[-1] for p in self.pairs if len(p))) + 1 if any(len(p) for p in self.pairs) else 1
        edges = np.array([top * k // RANGES for k in range(1, RANGES)], dtype=U)
        cuts = [np.concatenate([[0], np.searchsorted(p, edges), [len(p)]]) for p in self.pairs]
        gram_cuts = [np.searchsorted(g, c.astype(U) << U(CONTEXT_BITS)) for g, c in zip(self.grams, cuts, strict=True)]
        out: tuple[list[list[np.ndarray]], list[list[np.ndarray]]] = ([[] for _ in self.pairs], [[] for _ in self.pairs])
        for k in range(RANGES):
            pairs = [p[c[k] : c[k + 1]] for p, c in zip(self.pairs, cuts, strict=True)]
            grams = [g[c[k] : c[k + 1]] for g, c in zip(self.grams, gram_cuts, strict=True)]
            begin = np.cumsum([0, *(len(p) for p in pairs)])
            # the pair of each trigram among the pairs of all chunks
            of = np.concatenate([(g >> U(CONTEXT_BITS)).astype(np.int64) + (b - c[k]) for g, b, c in zip(grams, begin, cuts, strict=False)])
            seen = np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(self.seen, gram_cuts, strict=True)]).astype(np.int64)
            ends = np.cumsum([len(g) for g in grams])[:-1]
            h2 = np.concatenate(grams) & U((1 << CONTEXT_BITS) - 1)
            # whole numbers below 2 ** 53 are exact here
            asked = np.concatenate(pairs)
            second = Root(asked, np.bincount(of, seen, begin[-1]).astype(np.int64), 1 << PAIR_BITS)
            place = second.ids.find(asked)
            node = place[of]
            keys, sums = _added((node.astype(U) << U(CONTEXT_BITS)) | h2, seen)
            third = Level(keys >> U(CONTEXT_BITS), keys & U((1 << CONTEXT_BITS) - 1), sums, second.ids.n, 1 << CONTEXT_BITS)
            for held, answers in zip(out, (np.split(_values(second.values, place), begin[1:-1]), np.split(third.value(third.find(node, h2)), ends)), strict=True):
                for chunk, x in zip(held, answers, strict=True):
                    chunk.append(x)
        return out


def _answered(batches, shards: int):
    """The counts of what each chunk dealt to this shard, in its order, and the shard's totals."""
    shard = _Shard(batches)
    if not shard.of:
        return
    # relative to the shard's range; in other shards than the end's no word has this
    words, *first = shard.word_counts((int(END) - int(_bounds(shards)[shard.of[0][0]])) % (1 << 64))
    pairs, grams = shard.gram_counts()
    for (number, chunk, digest), w, p, g in zip(shard.of, words, pairs, grams, strict=True):
        counts = np.concatenate([w, *p, *g])
        kind = np.uint32 if counts.max(initial=0) < 1 << 32 else U
        sizes = np.array([len(w), sum(map(len, p)), np.dtype(kind).itemsize], np.int64)
        yield pa.RecordBatch.from_pylist([dict(zip(_fields(ANSWERS), (number, chunk, digest, sizes.tobytes() + pack([counts.astype(kind)]), *first), strict=True))], schema=_ARROW_ANSWERS)
        first = [0, 0, 0]


_ARROW_ANSWERS = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in ANSWERS.split(", "))])


def _read_again(batches):
    """The chunks' tokens, with their documents."""
    for batch, digest, ids, held, sizes, words, word in _chunks(batches):
        columns = [pa.array([batch], pa.int64()), pa.array([digest], pa.int64()), pa.array([encoded(words, 1 << 64)], pa.binary()), pa.array([pack([word.astype(np.uint32)])], pa.binary())]
        lists = (pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (held.tolist(), pa.bool_()), (sizes.tolist(), pa.int64())))
        yield pa.RecordBatch.from_arrays([*columns, *lists], names=_fields(CHUNKS))


class Corpus:
    """Totals of what is learned from, b and m."""

    def __init__(self, total: int, vocabulary: int, docs: int, b: float, m: float):
        self.total, self.vocabulary, self.docs, self.b, self.m = total, vocabulary, docs, b, m


def _likelihoods(g: Grams, x: np.ndarray, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, corpus: Corpus, share: int) -> np.ndarray:
    """What a chunk adds to the leave-one-out likelihood of each b and m; x: its training tokens of each trigram,
    c1, c2, c3: the counts of words, pairs and trigrams in all."""
    pair, turn = g.pair(), g.pairs % U(share) == 0
    mine = np.flatnonzero((x > 0) & turn[pair])
    x, of = x[mine], pair[mine]
    # a pair is the context of as many tokens as it has, but for those that end a text
    divides = np.bincount(of, x, len(g.pairs)) * (g.words[g.pair_word] != END)
    dividing = np.flatnonzero(divides)
    divides, below, first = divides[dividing], c2[dividing] - 1.0, c1[g.pair_word[dividing]] - 1.0
    seen, above, lowest = c3[mine] - 1.0, c2[of] - 1.0, c1[g.pair_word[of]] / max(corpus.total + corpus.vocabulary, 1)
    return np.array([x @ np.log(seen + b * above + m * lowest) - divides @ np.log(below + b * first + m) for b, m in GRID])


def _scored(chunk: pa.Table, answers: pa.Table, corpus: Corpus, share: int) -> pa.Table:
    """The documents of a chunk with their scores for each b and m; the chunk's likelihoods on the first."""
    if chunk.num_rows != 1 or not answers.num_rows:
        raise ValueError("the documents were not the same when they were read again")
    words, tokens = (chunk.column(c)[0].as_py() for c in (2, 3))
    ids, held, sizes = (chunk.column(c).combine_chunks().flatten() for c in (4, 5, 6))
    (word,) = unpack(tokens, [np.uint32])
    size = sizes.to_numpy()
    g = Grams(decoded(words), word.astype(np.int64), size)
    found: list[list[np.ndarray]] = [[], [], []]
    for k in np.argsort(answers.column(0).to_numpy()):
        blob = answers.column(3)[int(k)].as_py()
        n, pairs, width = (int(i) for i in np.frombuffer(blob, np.int64, 3))
        (counts,) = unpack(blob[24:], [np.uint32 if width == 4 else U])
        for kept, x in zip(found, np.split(counts, [n, n + pairs]), strict=True):
            kept.append(x)
    c1, c2, c3 = (np.concatenate(x).astype(np.float64) for x in found)
    if (len(c1), len(c2), len(c3)) != (len(g.words), len(g.pairs), len(g.grams)):
        raise ValueError("the documents were not the same when they were read again")
    start, pair, p1 = np.cumsum(size) - size, g.pair(), (c1 + 1) / (corpus.total + corpus.vocabulary + 1)
    x = np.bincount(g.gram[np.repeat(~held.to_numpy(zero_copy_only=False), size)], minlength=len(g.grams))
    fit = _likelihoods(g, x, c1, c2, c3, corpus, share)
    known, base = np.add.reduceat((c1 > 0).astype(np.int64)[g.word], start), np.add.reduceat(np.log10(p1)[g.word], start)
    # as contexts, a word and its h1 divide what follows them - nothing follows an end
    follows, first, lowest = g.words[g.pair_word] != END, c1[g.pair_word], p1[g.pair_word]
    scores = np.empty((len(size), len(GRID)))
    for k, (b, m) in enumerate(GRID):
        divisor = np.where(follows, np.log(c2 + b * first + m), 0.0)
        value = np.log(c3 + (b * c2 + m * lowest)[pair]) - divisor[pair]
        scores[:, k] = (np.add.reduceat(value[g.gram], start) - np.log(corpus.docs + b * corpus.docs + m)) / np.log(10)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * len(GRID), pa.int32()), pa.array(scores.ravel()))
    fits = pa.array([fit.tolist(), *[None] * (len(size) - 1)], pa.list_(pa.float64()))
    return pa.Table.from_arrays([ids, held, sizes, pa.array(known), pa.array(base), lists, fits], names=_fields(SCORES))


def weights(fit: np.ndarray, docs: int, share: int = PAIR_SHARE) -> tuple[float, float]:
    """b and m with the highest leave-one-out likelihood; ``fit`` is all but the first contexts of documents."""
    return GRID[int(np.argmax(fit - np.array([docs * np.log(max(docs - 1, 0) * (1 + b) + m) / share for b, m in GRID])))]


def score(documents: DataFrame) -> DataFrame:
    """Every row's doc_id, held_out, n_tokens, n_known, base_score, score and train_tokens."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_SHARD), 1)
    dealt = docs.mapInArrow(partial(_dealt, shards=shards), BLOBS).repartitionById(shards, "shard")
    answers = written(dealt.mapInArrow(partial(_answered, shards=shards), ANSWERS), "answers")
    totals = answers.agg(*(F.sum(c).alias(c) for c in ("total", "vocabulary", "docs"))).first()
    known = [totals[c] or 0 for c in ("total", "vocabulary", "docs")]
    finish = partial(_scored, corpus=Corpus(*known, 0.0, 0.0), share=PAIR_SHARE)
    chunks = docs.mapInArrow(_read_again, CHUNKS)
    both = chunks.groupBy("batch", "digest").cogroup(answers.groupBy("batch", "digest"))
    scored = written(both.applyInArrow(lambda chunk, found: finish(chunk, found), SCORES), "scores")
    fits = scored.where("fit IS NOT NULL").select(F.posexplode("fit").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # one row for each b and m
    fit = np.zeros(len(GRID))
    for r in fits:
        fit[r["k"]] = r["x"]
    corpus = Corpus(*known, *weights(fit, known[2], PAIR_SHARE))
    chosen = F.col("scores")[GRID.index((corpus.b, corpus.m))].alias("score")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", chosen, F.lit(known[0]).cast("long").alias("train_tokens"))


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
