"""Exact n-gram Jaccard self-join with prefix tries.

Every document is the set of its 5-word shingles, as 62-bit hashes under one global order: shingles
that many documents share come last (three levels, from a sketch sized by the documents), ties by hash.
Equal sets form one class.  Two classes of Jaccard similarity t or more share an element of their prefixes
(the first n - ceil(t n) + 1), and at their first common element both have enough elements left.

1. Prefix elements go to shards by element.  An element's bucket holds all classes with it.  Pairs of
   small buckets are counted; those whose prefixes share too little to be similar go.  A large bucket
   pairs every class with the bucket's most central one and keeps its rows for step 3.  Elements that
   the sketch shows to be hot are dealt by class too: they are large buckets whose rows no task holds
   together, and a join gives each row the central one.
2. Pairs whose parity sketches already show too large a difference go; the others are verified on
   whole sets.  The sets to hold against one class are put into a trie in
   global order and traversed with shared partial overlaps; subtrees that too few remaining elements
   can save are pruned.
3. Large buckets whose classes now lie in more than one component yield the pairs across components,
   which are verified too, in blocks of BLOCK_ROWS classes that those which can close a pair visit.
   So no link between components is lost and no bucket is expanded whole.

The order comes from approximate counts; it moves work, never results.  Defined results: null, empty
and blank texts have no set (n_shingles 0) and are their own component; repeated rows of one doc_id
with one text are one class; a row without a doc_id names no component and links nothing, it gets the
component of its text if a named row has it; a text of any length is one set, of all its shingles; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_kernels as K
from .blobs import pack, unpack
from .components import connected
from .storage import written

SHINGLE = 5
#: Similarity t = PART / WHOLE.
PART, WHOLE = 80, 100
#: Cells of the sketch for each document, and the bits that number its cells at least and at most.
CELLS, SKETCH_BITS = 64, (16, 27)
#: Sightings from which a shingle is common at all: in batches that have it twice or more.
LEAST_SEEN = 6
#: Shares of the documents from which it is common at the higher levels; the first of them has a bound
#: in documents too.  From that level on a shingle is hot.
COMMON, MANY, HOT_LEVEL = (1 / 1024, 1 / 64), 1 << 20, 2
#: Bits of a class's parity sketch.
PARITY_BITS = 1024
#: Classes in a bucket up to which all its pairs are counted at once.
SMALL = 64
#: Buckets that a class must share with a central one before the two are held against each other early.
CENTRAL = 3
#: Prefix elements meant for one shard.
PER_SHARD = 2_000_000
#: Sets put into one trie.
PER_TRIE = 256
#: Classes of a large bucket that are held against each other in one task.
BLOCK_ROWS = 2048
#: Cells of the filter on documents whose sets are needed, for each of them; and bounds of their bits.
FILTER_CELLS, FILTER_BITS = 8, (16, 29)

PROFILE = "doc_id long, key long, n long, class long, parity array<long>, cell int, seen long"
BLOBS = "shard int, blob binary"
FOUND = "kind int, token long, a long, b long, na int, nb int, seen int, ok boolean"
SETS = "class long, doc_id long, members binary"
U = np.uint64


def required(na, nb):
    """The least overlap of sets of these sizes at similarity t."""
    return -(-(na + nb) * PART // (PART + WHOLE))


def prefix_length(n):
    return np.where(n > 0, n + (-n * PART // WHOLE) + 1, 0) if isinstance(n, np.ndarray) else (n - -(-n * PART // WHOLE) + 1 if n else 0)


def _fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit number for each sorted set; equal sets have equal ones.  0 for the empty set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(K.mix(values ^ U(0x5851F42D4C957F2D)), dtype=U)])
    n = np.diff(at)
    return np.where(n > 0, K.mix((sums[at[1:]] - sums[at[:-1]]) ^ (n.astype(U) * K.STEP)) | U(1), U(0))


def _sets(data, offsets):
    """Per block of documents: i, j, the sorted distinct shingles of each one after another, offsets."""
    for i, j, s, at in K.spaced_shingles(data, offsets, SHINGLE):
        s >>= U(2)
        own = [np.unique(s[at[d] : at[d + 1]]) for d in range(j - i)]
        yield i, j, np.concatenate(own) if own else s[:0], np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _parities(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set the parities of its elements by cell.  Where two sets' parities differ, an element
    of only one of them lies: the number of such cells is a lower bound of the symmetric difference."""
    out = np.empty((len(at) - 1, PARITY_BITS // 64), np.int64)
    cells = (values & U(PARITY_BITS - 1)).astype(np.int64)
    for d in range(len(out)):
        odd = (np.bincount(cells[at[d] : at[d + 1]], minlength=PARITY_BITS) & 1).astype(np.uint8)
        out[d] = np.packbits(odd).view(np.int64)
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    n, w = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(rows.ravel()))


def _profile(batches, bits: int):
    """Per document its set's size, fingerprint and parities, and cells of the sketch: shingles that
    some classes of a batch share, with how many."""
    names = ["doc_id", "key", "n", "class", "parity", "cell", "seen"]
    long = pa.int64()
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(1))
        ids, held, known, total = batch.column(0), [], np.zeros(0, U), 0

        def cells(held=held):
            every = np.sort(np.concatenate(held))
            held.clear()
            new = np.flatnonzero(np.append(len(every) > 0, every[1:] != every[:-1]))
            count = np.diff(np.append(new, len(every)))
            many = count > 1
            cell, seen, n = (every[new[many]] >> U(62 - bits)).astype(np.int32), count[many], int(many.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, long), pa.nulls(n, long), pa.nulls(n, long), pa.nulls(n, long), pa.nulls(n, pa.list_(long)), pa.array(cell), pa.array(seen, long)], names=names)

        for i, j, values, at in _sets(data, offsets):
            prints = _fingerprints(values, at)
            yield pa.RecordBatch.from_arrays([ids[i:j], batch.column(2)[i:j], pa.array(np.diff(at)), pa.array(prints.view(np.int64)), _lists(_parities(values, at)), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, long)], names=names)
            _, first = np.unique(prints, return_index=True)
            fresh = np.zeros(j - i, bool)
            fresh[first] = ~np.isin(prints[first], known)
            known = np.concatenate([known, prints[fresh]])
            held.append(values[np.repeat(fresh, np.diff(at))])
            total += len(held[-1])
            if total >= 8_000_000:
                yield cells()
                total = 0
        if held:
            yield cells()


def _ordered(values: np.ndarray, at: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The sets under the global order: the level in the two highest bits, sorted within each set."""
    cell = (values >> U(62 - (8 * len(levels[0])).bit_length() + 1)).astype(np.int64)
    keys = values.copy()
    for bits in levels:
        keys += ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(U) << U(62)
    moved = np.concatenate([[0], np.cumsum(keys != values)])
    for d in np.flatnonzero(moved[at[1:]] > moved[at[:-1]]):
        keys[at[d] : at[d + 1]].sort()
    return keys


def _prefixes(batches, sent, shards: int):
    """Prefix elements of the batch's classes, dealt over the shards, one blob for each."""
    levels = sent.value
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(0))
        token, owner, size, place, known = [], [], [], [], np.zeros(0, U)
        held = 0

        def flush():
            t = np.concatenate(token)
            o = np.concatenate(owner)
            shard, hot = t % U(shards), _is_hot(t)
            shard[hot] = K.mix(t[hot] ^ o[hot].view(U)) % U(shards)
            shard = shard.astype(np.int64)
            order = np.lexsort((t, shard))
            columns = [t[order], o[order], np.concatenate(size)[order], np.concatenate(place)[order]]
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edges))
            for x in (token, owner, size, place):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack([np.ascontiguousarray(c[edges[s] : edges[s + 1]]) for c in columns]) for s in full], pa.binary())], names=["shard", "blob"])

        for _, _, values, at in _sets(data, offsets):
            n, prints = np.diff(at), _fingerprints(values, at)
            keys = _ordered(values, at, levels)
            _, first = np.unique(prints, return_index=True)
            fresh = first[(prints[first] != 0) & ~np.isin(prints[first], known)]
            known = np.concatenate([known, prints[fresh]])
            length = prefix_length(n[fresh])
            held += int(length.sum())
            steps = np.arange(length.sum()) - np.repeat(np.concatenate([[0], np.cumsum(length)])[:-1], length)
            token.append(keys[np.repeat(at[fresh], length) + steps])
            owner.append(np.repeat(prints[fresh].view(np.int64), length))
            size.append(np.repeat(n[fresh].astype(np.int32), length))
            place.append(steps.astype(np.int32))
            if held >= 4_000_000:
                yield flush()
                held = 0
        if held:
            yield flush()


def _is_hot(token: np.ndarray) -> np.ndarray:
    """Whether elements, levels in their highest bits, are of a hot level."""
    return (token >> U(62)) >= U(HOT_LEVEL)


def _can_match(na, nb, pa_, pb):
    """Whether sets of these sizes whose first common element stands at these places can be similar."""
    low, high = np.minimum(na, nb).astype(np.int64), np.maximum(na, nb).astype(np.int64)
    return (low * WHOLE >= high * PART) & (np.minimum(na - pa_, nb - pb) >= required(low, high))


def _found(kind, token, a, b, na, nb, seen, ok) -> pa.RecordBatch:
    n = len(a)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
    return pa.RecordBatch.from_arrays(
        [full(kind, np.int32), full(token, np.int64), full(a, np.int64), full(b, np.int64), full(na, np.int32), full(nb, np.int32), full(seen, np.int32), full(ok, bool)],
        names=["kind", "token", "a", "b", "na", "nb", "seen", "ok"],
    )


def _counted(kind, a, b, na, nb, ok) -> pa.RecordBatch:
    """The distinct pairs, the lesser class first, with how often they come and whether any is ok."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb, ok = a[order], b[order], na[order], nb[order], ok[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    any_ok = np.logical_or.reduceat(ok, start) if len(start) else ok
    return _found(kind, 0, a[start], b[start], na[start], nb[start], np.diff(np.append(start, len(a))), any_ok)


def _unique_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]):
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _buckets(table: pa.Table, small_size: int) -> pa.Table:
    """Kind 0: pairs of the shard's small buckets, in how many they meet, and whether they can match
    where they meet.  Kind 1: rows of the large buckets.  Kind 2: the large buckets' most central
    class with each other one that it can match."""
    parts = [unpack(x.as_py(), [U, np.int64, np.int32, np.int32]) for x in table.column("blob")]
    token, owner, size, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
    # a class may come once from each batch
    order = np.lexsort((owner, place, token))
    token, owner, size, place = token[order], owner[order], size[order], place[order]
    again = np.concatenate([[False], (token[1:] == token[:-1]) & (owner[1:] == owner[:-1])])
    token, owner, size, place = token[~again], owner[~again], size[~again], place[~again]
    hot = _is_hot(token)
    passed = [x[hot] for x in (token, owner, size, place)]
    token, owner, size, place = (x[~hot] for x in (token, owner, size, place))
    start = np.flatnonzero(np.append(len(token) > 0, token[1:] != token[:-1]))
    count = np.diff(np.append(start, len(token)))
    rows = lambda s, c: np.arange(c.sum()) - np.repeat(np.concatenate([[0], np.cumsum(c)])[:-1] - s, c)
    out = [_found(1, passed[0].view(np.int64), passed[1], 0, passed[2], passed[3], 1, False)]
    small = (count > 1) & (count <= small_size)
    if small.any():
        s, c = start[small], count[small]
        x = rows(s, c)
        later = np.repeat(s + c, c) - x - 1  # classes of the bucket after this one
        y = rows(x + 1, later)
        x = np.repeat(x, later)
        out.append(_counted(0, owner[x], owner[y], size[x], size[y], _can_match(size[x], size[y], place[x], place[y])))
    large = count > small_size
    if large.any():
        s, c = start[large], count[large]
        y = rows(s, c)
        out.append(_found(1, token[y].view(np.int64), owner[y], 0, size[y], place[y], 1, False))
        x, y = np.repeat(s, c - 1), rows(s + 1, c - 1)
        ok = _can_match(size[x], size[y], place[x], place[y])
        x, y = x[ok], y[ok]
        out.append(_counted(2, owner[x], owner[y], size[x], size[y], np.ones(len(x), bool)))
    return pa.Table.from_batches(out, _found(0, 0, *[np.zeros(0)] * 6).schema)


def _across(batches):
    """Rows (token, block, class, size, place, component, side, parity) sorted by token, block and
    component: the pairs of a block's own classes (side 1) and its visitors (side 0) across components
    that can match.  Rows of one key may come in several batches; those before are kept, since a pair
    may lie in any two of them."""
    kept = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
        # unsigned: bitwise_count takes a signed number's magnitude
        rows.append(batch.column(7).flatten().to_numpy(zero_copy_only=False).view(U).reshape(n, -1))
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        fresh_from = 0 if kept is None else len(kept[0])
        token, block = rows[:2]
        edges = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1])) + 1, [len(token)]])
        pairs = []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            owner, size, place, component, side, parity = (x[s:e] for x in rows[2:])
            turn = np.flatnonzero(component[1:] != component[:-1]) + 1
            for i, f in zip(turn, np.append(turn, e - s)[1:], strict=True):
                # the classes of one component against all before it
                for y in range(max(i, fresh_from - s), f):
                    ok = _can_match(size[:i], size[y], place[:i], place[y])
                    ok = np.flatnonzero(ok & (side[:i] != side[y]))
                    if len(ok):
                        differ = np.bitwise_count(parity[ok] ^ parity[y]).sum(axis=1, dtype=np.int64)
                        both = size[ok].astype(np.int64) + size[y]
                        ok = ok[(both - differ) // 2 >= -(-both * PART // (PART + WHOLE))]
                        pairs.append((np.minimum(owner[ok], owner[y]), np.maximum(owner[ok], owner[y])))
        kept = [x[edges[-2] :] for x in rows]
        if pairs:
            a, b = _unique_pairs(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """The set of the numbers in ``cell``, all below 2**bits, as bits: tasks make 4 KB pieces of it."""
    pieces = cells.select((F.col("cell") + 1).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("piece"))
    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for k, piece in pieces.toLocalIterator():  # 2**(bits - 15) pieces at most
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(piece, np.uint8)
    return out


def _bits(cells: int, bounds: tuple[int, int]) -> int:
    return min(max(int(cells).bit_length(), bounds[0]), bounds[1])


def _needed_sets(batches, sent, levels_sent):
    bits, levels = sent.value, levels_sent.value
    width = (8 * len(bits)).bit_length() - 1
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cell = (K.mix(ids.view(U)) >> U(64 - width)).astype(np.int64)
        rows = np.flatnonzero((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
        if not len(rows):
            continue
        data, offsets = K.text_bytes(batch.column(1).take(pa.array(rows)))
        for i, _, values, at in _sets(data, offsets):
            prints, keys = _fingerprints(values, at).view(np.int64), _ordered(values, at, levels)
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(prints[full]), pa.array(ids[rows][i + full]), pa.array([keys[at[d] : at[d + 1]].tobytes() for d in full], pa.binary())], names=["class", "doc_id", "members"])


def trie_matches(probe: np.ndarray, sets: list[np.ndarray], steps: int = 64) -> np.ndarray:
    """Which of the ordered sets are similar to the probe.

    Sorted as sequences the sets are the leaves of a trie in depth-first order; what a set has in
    common with the one before is a path both share, and so is its overlap with the probe.  A path is
    left as soon as the elements that remain on either side cannot give the overlap asked for.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
    good = np.zeros(len(sets), bool)
    path, overlap = probe[:0], np.zeros(1, np.int64)  # overlap[d]: elements of path[:d] in the probe
    for i in order:
        own = sets[i]
        shortest = min(len(path), len(own))
        differ = np.flatnonzero(path[:shortest] != own[:shortest])
        depth = int(differ[0]) if len(differ) else shortest
        depth = min(depth, len(overlap) - 1)
        counts, need = [overlap[: depth + 1]], int(required(len(probe), len(own)))
        have = int(overlap[depth])
        if min(len(probe), len(own)) >= need:
            while depth < len(own):
                left = len(probe) - int(np.searchsorted(probe, own[depth]))
                if have + min(len(own) - depth, left) < need:
                    break
                part = own[depth : depth + steps]
                spot = np.searchsorted(probe, part)
                spot[spot == len(probe)] = 0
                grown = have + np.cumsum(probe[spot] == part)
                counts.append(grown)
                have, depth = int(grown[-1]), depth + len(part)
            good[i] = depth == len(own) and have >= need
        path, overlap = own, np.concatenate(counts)
    return good


def _verified(batches):
    """Rows (a, part, role, b, set) sorted so that a trie's probe comes first: the similar pairs."""
    key, probe, names, sets = None, None, [], []

    def done():
        good = trie_matches(probe, sets) if sets and probe is not None else np.zeros(0, bool)
        return [(key[0], b) for b, ok in zip(names, good, strict=False) if ok]

    for batch in batches:
        out = []
        a, part, role, b, members = (batch.column(k) for k in range(5))
        for x, p, r, y, m in zip(a.to_pylist(), part.to_pylist(), role.to_pylist(), b.to_pylist(), members, strict=True):
            if (x, p) != key:
                if key is not None:
                    out += done()
                key, probe, names, sets = (x, p), None, [], []
            if r == 0:
                probe = np.frombuffer(m.as_py(), U)
            else:
                names.append(y)
                sets.append(np.frombuffer(m.as_py(), U))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], names=["a", "b"])
    if key is not None and (out := done()):
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], names=["a", "b"])


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, levels_sent, parts: int) -> DataFrame:
    """The similar ones of the distinct class pairs (a, b); written."""
    spark = pairs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = written(ends.join(classes.select("class", "doc_id"), "class"), "needed")
    width = _bits(FILTER_CELLS * needed.count(), FILTER_BITS)
    bits = _bitmap(needed.select("doc_id").mapInArrow(partial(_cells, bits=width), "cell long"), width)
    sent = spark.sparkContext.broadcast(bits)
    # the filter lets a few other documents through; joins drop them
    sets = written(docs.mapInArrow(partial(_needed_sets, sent=sent, levels_sent=levels_sent), SETS), "sets")
    sets = sets.join(needed, ["class", "doc_id"], "left_semi").dropDuplicates(["class"]).select("class", "members")
    share = pairs.groupBy("a").agg((1 + F.floor(F.count("*") / PER_TRIE)).cast("int").alias("tries"))
    dealt = written(pairs.join(share, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("tries")).cast("int")).select("a", "part", "b"), "dealt")
    rows = dealt.join(sets.withColumnRenamed("class", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "members")
    probes = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("class", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "members")
    sorted_ = rows.unionByName(probes).repartition(parts, "a", "part").sortWithinPartitions("a", "part", "role", "b")
    return written(sorted_.mapInArrow(_verified, "a long, b long"), "similar")


def _cells(batches, bits: int):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((K.mix(ids.view(U)) >> U(64 - bits)).astype(np.int64))], names=["cell"])


def _can_be_smaller():
    """Whether a class whose first common element stands at its place can match one of its size or more."""
    return F.expr(f"na - place >= (2 * na * {PART} + {PART + WHOLE - 1}) div {PART + WHOLE}")


def _rest(size: str):
    """Elements of a set after its prefix."""
    return F.expr(f"({size} * {PART} + {WHOLE - 1}) div {WHOLE} - 1")


def similar_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class, root, key) of each row: component_id is the least doc_id
    that links reach; root tells components apart even where they have that id in common (null without
    words); key is xxhash64 of the text."""
    spark = documents.sparkSession
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    docs = every.where("doc_id IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    sketch = _bits(CELLS * every.count(), SKETCH_BITS)
    profile = written(every.mapInArrow(partial(_profile, bits=sketch), PROFILE), "profile")
    own = profile.where("cell IS NULL").select("doc_id", "key", "n", "class", "parity")
    totals = own.agg(F.count("*").alias("docs"), F.sum("n").alias("elements")).first()
    n_docs, elements = totals["docs"], totals["elements"] or 0
    common = written(profile.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= LEAST_SEEN), "common")
    shares = [max(LEAST_SEEN, n_docs * rate) for rate in COMMON]
    levels = [_bitmap(common.where(F.col("seen") >= least), sketch) for least in (LEAST_SEEN, min(shares[0], MANY), max(shares))]
    levels_sent = spark.sparkContext.broadcast(levels)

    shards = max(parts, -(-int(elements * (1 - PART / WHOLE)) // PER_SHARD), 1)
    small = SMALL
    blobs = docs.select("text").mapInArrow(partial(_prefixes, sent=levels_sent, shards=shards), BLOBS)
    found = written(blobs.groupBy("shard").applyInArrow(lambda table: _buckets(table, small), FOUND), "buckets")
    classes = written(own.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min_by(F.struct("doc_id", "parity"), "doc_id").alias("r")).select("class", "r.*"), "classes")

    # the prefixes of two similar sets share so much that what is left can make up the rest; large
    # buckets, where pairs are not counted, may add as many as a class has of them
    rows = found.where("kind = 1").select("token", F.col("a").alias("class"), "na", F.col("nb").alias("place"))
    # a class of a hot element comes once from each batch that has it
    is_hot = F.shiftrightunsigned("token", 62) >= HOT_LEVEL
    hot = rows.where(is_hot).dropDuplicates(["token", "class"])
    rows = written(rows.where(~is_hot).unionByName(hot), "large-buckets")
    uncounted = rows.groupBy("class").agg(F.count("*").alias("more"))
    counted = found.where("kind = 0").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("seen").alias("seen"), F.max("ok").alias("ok")).where("ok")
    left = F.greatest(_rest("na"), _rest("nb"))
    needs = F.expr(f"((na + nb) * {PART} + {PART + WHOLE - 1}) div {PART + WHOLE}")
    for end in ("a", "b"):
        counted = counted.join(uncounted.select(F.col("class").alias(end), F.col("more").alias(f"more_{end}")), end, "left")
    counted = counted.where(F.col("seen") + F.coalesce(F.least("more_a", "more_b"), F.lit(0)) + left >= needs).select("a", "b", "na", "nb")
    # early links of large buckets: each class with the central one it meets most
    middle = rows.where(is_hot).groupBy("token").agg(F.min(F.struct("place", "class", "na")).alias("m"))
    beside = rows.where(is_hot).join(middle, "token").where("class <> m.class").select(F.least("class", "m.class").alias("a"), F.greatest("class", "m.class").alias("b"), F.col("na").alias("n1"), F.col("m.na").alias("n2"), (F.col("na") - F.col("place")).alias("left1"), (F.col("m.na") - F.col("m.place")).alias("left2"), F.col("class") < F.col("m.class"))
    beside = beside.toDF("a", "b", "n1", "n2", "left1", "left2", "lesser").where(f"least(n1, n2) * {WHOLE} >= greatest(n1, n2) * {PART} AND least(left1, left2) >= ((n1 + n2) * {PART} + {PART + WHOLE - 1}) div {PART + WHOLE}")
    beside = beside.select("a", "b", F.expr("CASE WHEN lesser THEN n1 ELSE n2 END").alias("na"), F.expr("CASE WHEN lesser THEN n2 ELSE n1 END").alias("nb"), F.lit(1).alias("seen"))
    central = found.where("kind = 2").select("a", "b", "na", "nb", "seen").unionByName(beside).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("seen").alias("seen")).where(F.col("seen") >= CENTRAL)
    ends = central.select(F.explode(F.array("a", "b")).alias("end"), "a", "b", "na", "nb", "seen").groupBy("end").agg(F.max_by(F.struct("a", "b", "na", "nb"), F.struct("seen", "a", "b")).alias("p"))
    first = counted.unionByName(ends.select("p.*")).distinct()
    # the parity sketches of both ends bound the symmetric difference
    for end in ("a", "b"):
        first = first.join(classes.select(F.col("class").alias(end), F.col("parity").alias(f"parity_{end}")), end)
    differ = F.expr("aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    first = written(first.where(F.floor((F.col("na") + F.col("nb") - differ) / 2) >= needs).select("a", "b"), "pairs")
    links = _verify(first, docs, classes, levels_sent, parts)
    roots = connected(links)
    labelled = rows.join(roots.withColumnRenamed("node", "class"), "class", "left").select("token", "class", "na", "place", F.coalesce("root", "class").alias("component"))
    # A pair across components has a class outside the bucket's largest component, and its smaller class
    # can match one of its own size: the fewer of these two kinds visit all blocks of the bucket.
    of_parts = labelled.groupBy("token", "component").agg(F.count("*").alias("n"), F.sum(_can_be_smaller().cast("int")).alias("smaller"))
    mixed = of_parts.groupBy("token").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.sum("smaller").alias("smaller")).where("components > 1")
    mixed = mixed.select("token", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.col("most.component").alias("largest"), (F.col("smaller") <= F.col("n") - F.col("most.n")).alias("by_size"))
    open_ = labelled.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    visits = F.when(F.col("by_size"), _can_be_smaller()).otherwise(F.col("component") != F.col("largest"))
    to = F.array_append(F.when(visits, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.expr("CAST(array() AS array<int>)")), -1 - F.col("own"))
    open_ = open_.select("token", "class", "na", "place", "component", F.explode(to).alias("to"))
    open_ = open_.select("token", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).cast("long").alias("block"), "class", "na", "place", "component", (F.col("to") < 0).cast("int").alias("side"))
    open_ = open_.join(classes.select("class", "parity"), "class").select("token", "block", "class", "na", "place", "component", "side", "parity")
    open_ = open_.repartition(parts, "token", "block").sortWithinPartitions("token", "block", "component", "place")
    second = written(open_.mapInArrow(_across, "a long, b long").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        links = links.unionByName(_verify(second, docs, classes, levels_sent, parts))
        roots = connected(links)
    # from classes to documents
    named = classes.drop("parity").join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("class", "root", "component_id")
    out = own.drop("parity").join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class", "root", "key")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(documents: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """All pairs by their literal shingles, for tests."""
    import re

    sets = {}
    for doc_id, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and WHOLE * len(x & y) >= PART * len(x | y) and (p := root(a)) != (q := root(b)):
                label[max(p, q)] = min(p, q)
    return [(d, len(sets[d]), root(d)) for d, _ in documents]
