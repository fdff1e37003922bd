"""N-gram Jaccard join by token-combination prefixes.

Documents with the same set of word shingles ("tokens") are one class; only a class's smallest doc_id goes on. All tokens
have one global order: rare ones before frequent ones, by hash within each kind. Two sets that are similar enough must
agree inside a prefix of that order, and how much of it is told by the kinds:

- a rare token is a signature of its own;
- a token of a frequent class is dealt to one of several parts of its class, and k of them from one part, taken together,
  are a signature: k is 2 for the first frequent class and 3 for the second.

A set x may miss at most |x| - t of its tokens, where t is the least overlap that a link needs. Its prefix is extended
until the rare tokens and, of each part, the tokens beyond its first k - 1 come to more than that. Of two linked sets, the
prefix that ends first then shares a rare token with the other set, or k tokens of one part; and as the other prefix
reaches further, they are inside it too. So every link shares a signature. Documents whose rare tokens suffice, which are
nearly all of them, never make a combination and never meet in a frequent token.

Frequency is counted exactly over all documents' heads, the first tokens by hash: as many as a prefix needs and an eighth
more. Documents that have too few rare tokens there ("poor" ones) bring their whole sets; what is frequent among these
counts as frequent too. A token's kind is looked up where its set is, in bitmaps of the frequent tokens' hashes: one that only
has a place in common with a frequent token counts as frequent in all sets alike, which keeps the one order that links need.
A class's parts follow the size of the sets, in ranges that double; a set near the end of a range joins the next too.
Where sets are too small to be told by combinations (below four tokens at 0.8), frequent tokens stand alone.

Candidates are the members of a signature with its smallest id (a star), where their sizes allow a link. Each document first meets the one that it shares
most signatures with, then those of other components. Bitmaps of two sets bound their overlap from above, which drops most
pairs exactly: a bit that only one of them has proves a token that the other one lacks. The others are verified on whole
sets, which move once, to the smaller id. Members that stay in different components of one signature, in one range of sizes
or two neighbouring ones, have their bitmaps compared in blocks of BLOCK inside tasks, which give out pairs alone. Of
signatures with the same members one is enough. Pairs that the bitmaps leave are verified on whole sets where they met: a set goes once to each of its blocks
however many partners it has there. Pairs with a set of more than LONG tokens are verified as before.

Defined results: a null or blank text has an empty set and is linked with nothing; a null doc_id is linked with nothing
and has a null component; rows that share a doc_id are one document that has each of their texts; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, as_bytes, column, groups, prepare, released, slices, written
from .components import components
from .minhash import _shingle_sets, _verify
from .shingles import mix, shingle_set

#: Documents in whose heads a token of the first, and of the second frequent class occurs more than.
FREQUENT = (64, 4096)
#: Missing tokens of the smallest set of a size range for each part of a frequent class.
SPREAD = 4
#: Members of one signature whose bitmaps a task compares with those of as many others.
BLOCK = 256
#: Bits of a bitmap for each token, and twice that at most.
BITS = 4
#: Bits for each frequent and for each shared token in the bitmaps that tasks get, to a power of two, and at most (16 MB).
#: Beyond it more tokens count as frequent, or are handed on as shared, and none fewer.
FREQUENT_BITS, SHARED_BITS, MAX_BITS = 64, 16, 1 << 27
#: Tokens of the largest set that is verified among a block's; twice BLOCK of these (128 MB) are held at a time.
LONG = 1 << 15


class Join:
    """Shingle length and the threshold num/den of the Jaccard similarity."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * self.den < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both * self.den >= self.num * (len(a) + len(b) - both)

    def needed(self, n: int) -> int:
        """Weight of a prefix of a set of n: one more than the tokens that a link can lack, as its overlap is num/den of
        the larger set at least."""
        return n - -(-self.num * n // self.den) + 1

    def head(self, n: int) -> int:
        need = self.needed(n)
        return min(n, need + need // 8 + 1)

    def ranges(self, n: int) -> set[int]:
        """Size ranges [2^r, 2^(r+1)) of a set of n and of the largest set that it can be linked with."""
        return {n.bit_length() - 1, (n * self.den // self.num).bit_length() - 1}

    @property
    def width(self) -> float:
        """Width of ranges of the logarithm of sizes, so that linked sets are in one or in neighbouring ones whatever the
        last digits of their logarithms are."""
        return max(0.2, 1.001 * math.log(self.den / self.num))

    def parts(self, r: int) -> int:
        return max(1, self.needed(1 << r) // SPREAD)

    def combined(self, r: int) -> bool:
        """Whether every set of a range reaches its prefix's weight where all of its tokens are frequent: each part of the
        first class takes one token of it at most, of the second two. Else the range's frequent tokens stand alone."""
        low = -(-(1 << r) * self.num // self.den)
        return 2 * self.num >= self.den and all(n - 3 * self.parts(r) >= self.needed(n) for n in range(low, low + self.den))


def least_hashes(values: np.ndarray) -> np.ndarray:
    """Tokens in their global order by hash, as signed numbers."""
    return np.sort(mix(values).view(np.int64))


def signatures_of(tokens: np.ndarray, kinds: np.ndarray, join: Join) -> list[int]:
    """Signatures of a set whose tokens have the kinds given (0 rare, 1 and 2 frequent)."""
    order = np.lexsort((tokens, kinds))
    tokens, kinds = tokens[order], kinds[order]
    rare = tokens[kinds == 0]
    need, out = join.needed(len(tokens)), rare[: join.needed(len(tokens))].tolist()
    if len(rare) >= need:
        return out
    for r in join.ranges(len(tokens)):
        weight, parts, held, combined = len(rare), join.parts(r), {}, join.combined(r)
        for token, kind in zip(tokens[len(rare) :].tolist(), kinds[len(rare) :].tolist()):
            if weight >= need:
                break
            own = held.setdefault((kind, (token >> 7) % parts), [])
            own.append(token)
            weight += len(own) > kind * combined
        for (kind, _), own in held.items():
            for some in combinations(own, kind * combined + 1):
                out.append(xxhash.xxh3_64_intdigest(np.array([r, kind, *some], np.int64).tobytes()) - (1 << 63))
    return out


def _heads(join: Join):
    """Texts to the size and digest of their sets, and the first tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, classes, heads, bits = [], [], [], []
                for text in as_bytes(column(part, "text")):
                    values = shingle_set(text, join.k)
                    sizes.append(len(values))
                    classes.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                    tokens = least_hashes(values)
                    heads.append(tokens[: join.head(len(values))] if len(values) else None)
                    bits.append(np.packbits(bitmap(tokens)).tobytes() if len(values) else None)
                yield pa.record_batch(
                    [column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["doc_id", "n_shingles", "class", "head", "bits"],
                )

    return released(run)


#: Rows that a task hands on at a time.
_ROWS = 1 << 16


def _rows(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of numbers, joined to batches of _ROWS rows or a little more."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= _ROWS:
            yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names)
            held, n = [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names)


def _places(tokens: DataFrame, each: int) -> np.ndarray:
    """Tokens as bits, `each` of them for one token; their number is a power of two, MAX_BITS at most."""
    bits = min(MAX_BITS, max(1 << 15, 1 << (each * tokens.count() - 1).bit_length()))
    at = F.pmod("token", F.lit(bits))
    rows = tokens.groupBy(F.floor(at / 32768).alias("b")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # MAX_BITS bounds it
        out[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def placed(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which of the tokens have a place in the bitmap."""
    at = tokens & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _frequent(frequent: DataFrame):
    """Bitmaps of the tokens (token, n) of each frequent class and those above it, for tasks."""
    bits = tuple(_places(frequent.where(F.col("n") > more).select("token"), FREQUENT_BITS) for more in FREQUENT)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def kinds_of(bits: tuple[np.ndarray, ...], tokens: np.ndarray) -> np.ndarray:
    first, second = (placed(b, tokens) for b in bits)
    return first.astype(np.int64) + (first & second)


class _Heads:
    """Heads of a batch: their tokens, the row that each is of, and which of them are to be its row's prefix."""

    def __init__(self, batch: pa.RecordBatch, bits: tuple[np.ndarray, ...], join: Join):
        heads, self.sizes = column(batch, "head"), column(batch, "n_shingles").to_numpy()
        self.tokens = heads.flatten().to_numpy()
        lengths = heads.value_lengths().to_numpy()
        self.row = np.repeat(np.arange(len(heads)), lengths)
        need, rare = join.needed(self.sizes), ~placed(bits[0], self.tokens)
        before = np.concatenate([[0], np.cumsum(rare)])
        ends = np.cumsum(lengths)
        self.poor = before[ends] - before[ends - lengths] < need
        self.prefix = rare & (before[1:] - before[ends - lengths][self.row] <= need[self.row]) & ~self.poor[self.row]


def _short(frequent, join: Join):
    """Ids of the heads that have fewer rare tokens than a prefix needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([column(batch, "id").filter(pa.array(_Heads(batch, frequent.value, join).poor))], ["id"])

    return released(run)


def _plain(frequent, shared, join: Join):
    """Rare tokens of the prefixes of documents that are not poor, where somebody else may have them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                heads = _Heads(batch, frequent.value, join)
                some = heads.prefix & placed(shared.value, heads.tokens)
                row, ids = heads.row[some], column(batch, "id").to_numpy()
                yield [heads.tokens[some], ids[row], heads.sizes[row]]

        yield from _rows(parts(), ["key", "id", "n"])

    return released(run)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of whole sets (id, values)."""

    def parts():
        for batch in batches:
            for values in column(batch, "values"):
                tokens = least_hashes(np.frombuffer(values.as_buffer(), np.uint64))
                for at in range(0, len(tokens), _ROWS):
                    yield [tokens[at : at + _ROWS]]

    yield from _rows(parts(), ["token"])


def _poor(frequent, join: Join):
    """Whole sets (id, values) to the signatures (key, id) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for i, values in zip(column(batch, "id").to_pylist(), column(batch, "values")):
                    tokens = least_hashes(np.frombuffer(values.as_buffer(), np.uint64))
                    made = np.array(signatures_of(tokens, kinds_of(frequent.value, tokens), join), np.int64)
                    yield [made, np.full(len(made), i, np.int64)]

        yield from _rows(parts(), ["key", "id"])

    return released(run)


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray, join: Join) -> bool:
    """Whether sets of sizes n and m can be linked, as far as their heads tell: up to the last token of the head that ends
    first all tokens of both are known; beyond it, at most the rest of the smaller one is shared."""
    if min(n, m) * join.den < join.num * max(n, m):
        return False
    last = min(a[-1], b[-1])
    a, b = a[: np.searchsorted(a, last, "right")], b[: np.searchsorted(b, last, "right")]
    most = len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b))
    return most * join.den >= join.num * (n + m - most)


def bits_allow(n: int, a: np.ndarray, m: int, b: np.ndarray, join: Join) -> bool:
    """Whether sets of sizes n and m can be linked, as far as their bitmaps (bytes) tell."""
    if min(n, m) * join.den < join.num * max(n, m):
        return False
    if len(a) != len(b):  # one is twice as long
        a, b = (x if len(x) <= min(len(a), len(b)) else x[: len(x) // 2] | x[len(x) // 2 :] for x in (a, b))
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return most * join.den >= join.num * (n + m - most)


def _bounded(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (column(batch, x).to_pylist() for x in ("n_a", "n_b"))
            a, b = ([np.frombuffer(x.as_buffer(), np.uint8) for x in column(batch, y)] for y in ("bits_a", "bits_b"))
            good = pa.array([bits_allow(*x, join) for x in zip(n, a, m, b)], pa.bool_())
            yield pa.record_batch([column(batch, x).filter(good) for x in ("a", "b")], ["a", "b"])

    return released(run)


def _repeated(tokens: DataFrame, more_than: int) -> DataFrame:
    """Tokens of more than so many of the sets given as rows, and of how many."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def _values(k: int):
    """Rows (a, b, text) with b's set in place of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = pa.array([shingle_set(t, k).tobytes() for t in as_bytes(column(part, "text"))], pa.binary())
                yield pa.record_batch([column(part, "a"), column(part, "b"), sets], ["a", "b", "values_b"])

    return released(run)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set as a power of two of bits (64 at least), BITS to twice that for each token, so that halves can be laid on each
    other."""
    bits = np.zeros(max(64, BITS << (len(tokens) - 1).bit_length()), bool)
    bits[tokens & (len(bits) - 1)] = True
    return bits


def pairs_left(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], join: Join, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of ids of different components that may be linked by their bitmaps; with `side` only those of different
    sides. Sets that can be linked have bitmaps of one length or of one and twice it."""
    widths, found = np.array([len(b) for b in bits]), []
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        x = np.stack([bits[i] if len(bits[i]) == width else bits[i].reshape(2, -1).any(axis=0) for i in at])
        both = np.zeros((len(at), len(at)), np.float32)
        for lo in range(0, width, 4096):
            part = x[:, lo : lo + 4096].astype(np.float32)
            both += part @ part.T
        n, only = sizes[at], x.sum(axis=1)[:, None] - both.astype(np.int64)  # bits of i that j has not
        most = np.minimum(n[:, None] - only, (n[:, None] - only).T)
        good = (join.den * most >= join.num * (n[:, None] + n - most)) & (np.minimum(n[:, None], n) * join.den >= join.num * np.maximum(n[:, None], n))
        good &= (np.minimum(widths[at][:, None], widths[at]) == width) & (comps[at][:, None] != comps[at])
        if side is not None:
            good &= side[at][:, None] != side[at]
        found.append(ids[at][np.argwhere(np.triu(good, 1))])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _blocks(join: Join):
    """Rows come sorted by (key, i, j): the members of blocks i and j of a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for (key, i, j), rows in groups(batches, ["key", "i", "j"]):
                if rows.num_rows < 2:
                    continue
                bits = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)).view(bool) for x in rows.column("bits")]
                ids, comps, sizes, side = (rows.column(c).to_numpy() for c in ("id", "component", "n_shingles", "own"))
                found = pairs_left(ids, comps, sizes, bits, join, side if j > i + 1 else None)  # pairs within a block meet beside its neighbour
                order = np.argsort(ids, kind="stable")
                size = np.maximum.reduceat(sizes[order], np.unique(ids[order], return_index=True)[1])  # sets that share an id
                most = size[np.searchsorted(np.unique(ids), found)].max(axis=1)
                yield [found.min(axis=1), found.max(axis=1), most, *(np.full(len(found), x, np.int64) for x in (key, i, j))]

        yield from _rows(parts(), ["a", "b", "most", "key", "i", "j"])

    return released(run)


def _linked(join: Join):
    """Rows (key, i, j, id, others, values), sorted by block, to the links (u, v) among each id and its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, rows in groups(batches, ["key", "i", "j"]):
                sets, asked = {}, set()
                for i, others, values in zip(rows.column("id").to_pylist(), rows.column("others").to_pylist(), rows.column("values")):
                    sets.setdefault(i, []).append(np.frombuffer(values.as_buffer(), np.uint64))
                    asked |= {(i, other) for other in others}
                found = [p for p in asked if any(join.linked(x, y) for x in sets[p[0]] for y in sets[p[1]])]
                yield [np.array([p[x] for p in found], np.int64) for x in (0, 1)]

        yield from _rows(parts(), ["u", "v"])

    return released(run)


def signatures(docs: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """(key, id, lo, hi) of the representatives (id, n_shingles, head, bits), each key of an id once: two linked ones share
    a key. lo and hi are the sizes of the id's smallest and largest set."""
    heads_of = reps.select("id", "n_shingles", "head")
    held = reps.select(F.explode("head").alias("token"))
    sizes = reps.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    twice = written(sizes.where("n > 1").select("id"), "twice")  # sets that share an id are looked at whole
    one = heads_of if twice.isEmpty() else heads_of.join(twice, "id", "left_anti")
    heads = written(_repeated(held, 1), "repeated")
    often = heads.where(F.col("n") > FREQUENT[0])
    first = written(one.mapInArrow(_short(_frequent(often), join), "id long").unionByName(twice), "poor")
    sets = _shingle_sets(docs, first, join.k)
    often = often.unionByName(_repeated(sets.mapInArrow(released(_tokens), "token long"), FREQUENT[0]))
    frequent = _frequent(written(often.groupBy("token").agg(F.max("n").alias("n")), "frequent"))
    poor = written(one.mapInArrow(_short(frequent, join), "id long").unionByName(twice), "poor")
    sets = sets.unionByName(_shingle_sets(docs, poor.join(first, "id", "left_anti"), join.k)).join(poor, "id", "left_semi")
    made = written(sets.mapInArrow(_poor(frequent, join), "key long, id long").distinct(), "signatures")
    # of the others' tokens those that are somebody else's too
    shared = written(heads.select("token").unionByName(made.select(F.col("key").alias("token"))).distinct(), "shared")
    bits = docs.sparkSession.sparkContext.broadcast(_places(shared, SHARED_BITS))
    plain = one.mapInArrow(_plain(frequent, bits, join), "key long, id long, n long").join(shared.toDF("key"), "key", "left_semi")
    plain = plain.select("key", "id", F.col("n").alias("lo"), F.col("n").alias("hi"))
    return written(plain.unionByName(made.join(sizes.drop("n"), "id").select("key", "id", "lo", "hi")), "signatures")


def _some(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """Sizes and bitmaps (id, n_shingles, bits) of the ids and few others; those of all the rest stay in their scan."""
    ids = written(ids.distinct(), "ids")
    return Filter(ids.select(F.xxhash64("id").alias("h")), ids.count()).split(reps.select("id", "n_shingles", "bits"), F.xxhash64("id"))[1]


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """Links (u, v) among pairs (a, b)."""
    pairs = written(pairs, "asked")  # Spark knows its size when it plans the joins
    side = lambda x: _some(reps, pairs.select(F.col(x).alias("id"))).toDF(x, f"n_{x}", f"bits_{x}")
    pairs = written(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_bounded(join), "a long, b long"), "pairs")
    rows = docs.select(F.col("doc_id").alias("b"), "text").where("text is not null and doc_id is not null")
    some = Filter(pairs.select(F.xxhash64("b").alias("h")).distinct(), pairs.count()).split(rows, F.xxhash64("b"))[1]
    moved = some.join(pairs, "b").select("a", "b", "text").mapInArrow(_values(join.k), "a long, b long, values_b binary")
    centres = _shingle_sets(docs, pairs.select(F.col("a").alias("id")).distinct(), join.k)
    return written(moved.join(centres.toDF("a", "values_a"), "a").mapInArrow(_verify(join), "u long, v long"), "links")


def linked_components(docs: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """(node, component) of representatives (id, n_shingles, head, bits) that are linked with others."""
    held = signatures(docs, reps, join)
    stars = held.groupBy("key").agg(F.min(F.struct("id", "lo", "hi")).alias("s"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = written(stars.select("key", F.col("s.id").alias("a"), F.col("s.lo").alias("lo_a"), F.col("s.hi").alias("hi_a"), "members"), "stars")
    buckets = written(held.join(stars, "key"), "buckets")
    alike = (F.col("hi") * join.den >= F.col("lo_a") * join.num) & (F.col("hi_a") * join.den >= F.col("lo") * join.num)
    met = buckets.where((F.col("id") != F.col("a")) & alike).groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    met = written(met, "met")
    best = met.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    links = _verified(docs, reps, best, join)
    comp = written(components(links), "components")
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    apart = met.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    # two that no link was found for may have met already; that is rare and found once more
    apart = apart.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    comp = _joined(comp, _verified(docs, reps, apart, join))
    left = _pairs_left(reps, buckets, comp, join)
    long = left.where(F.col("most") > LONG).select("a", "b")
    if not long.isEmpty():
        comp = _joined(comp, _verified(docs, reps, long, join))
    return _joined(comp, _links_left(docs, left.where(F.col("most") <= LONG), join))


def _links_left(docs: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """Links (u, v) among pairs (a, b, key, i, j): both sets meet in that block."""
    place = ["key", "i", "j"]
    members = pairs.select(*place, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(*place, F.col("b").alias("id"), F.lit(None).cast("long").alias("other")))
    members = written(members.groupBy(*place, "id").agg(F.collect_set("other").alias("others")), "meet")  # the others of one block
    sets = _shingle_sets(docs, members.select("id").distinct(), join.k)
    met = members.join(sets, "id").repartition(*place).sortWithinPartitions(*place)
    return written(met.mapInArrow(_linked(join), "u long, v long"), "links")


def _pairs_left(reps: DataFrame, buckets: DataFrame, comp: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b, most, key, i, j) that share a signature, are in different components, and may be linked by their
    bitmaps: the size of the larger set, and a block where they met."""
    at = lambda n: F.floor(F.log(n) / join.width)
    size = F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")) + 1)).alias("size")
    own = buckets.where("id <> a and members > 2").select("id", "key", "lo", "hi").join(comp.withColumnRenamed("node", "id"), "id", "left")
    own = own.select("id", F.coalesce("component", "id").alias("component"), (at(F.col("hi")) + 1).alias("above"), "key", size)
    # those of a range's sets and of the range below it that have the signature
    own = written(own.select("id", "component", F.xxhash64("key", "size").alias("key"), (F.col("size") < F.col("above")).alias("inside")), "members")
    same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"s{i}") for i in (0, 1)]  # an id is there once
    apart = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("inside").alias("inside"), *same)
    apart = apart.where("lo < hi and inside").groupBy("n", "lo", "hi", "s0", "s1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    apart = written(apart, "apart")
    some = Filter(apart.select(F.xxhash64("key").alias("h")), apart.count()).split(own.drop("inside"), F.xxhash64("key"))[1]
    members = written(some.join(apart, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))), "dealt")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own <> other or blocks = 1")
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component").join(_some(reps, members.select("id")), "id")
    met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = met.mapInArrow(_blocks(join), "a long, b long, most long, key long, i long, j long")
    return written(found.groupBy("a", "b").agg(F.max("most").alias("most"), F.min(F.struct("key", "i", "j")).alias("at")).select("a", "b", "most", "at.*"), "left")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with further links (u, v)."""
    if links.isEmpty():
        return comp
    return written(components(links.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")


def representatives(signed: DataFrame) -> DataFrame:
    """(id, n_shingles, head, bits) of each class, with its smallest id. Rows that are alone in their class stay in the scan."""
    again = written(signed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("class").alias("h")), "again")
    clear, maybe = Filter(again, again.count()).split(signed.select(F.col("doc_id").alias("id"), "n_shingles", "class", "head", "bits"), F.xxhash64("class"))
    held = F.struct("n_shingles", "head", "bits")
    firsts = maybe.groupBy("class").agg(F.min("id").alias("id"), F.any_value(held).alias("x")).select("id", "x.*")
    return clear.drop("class").unionByName(written(firsts, "classes"))


def ngram_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs; links need Jaccard >= num / den."""
    prepare(docs.sparkSession)
    join = Join(k, num, den)
    signed = docs.select("doc_id", "text").mapInArrow(_heads(join), "doc_id long, n_shingles long, class binary, head array<long>, bits binary")
    signed = written(signed, "heads")
    some = signed.where("class is not null and doc_id is not null")
    comp = linked_components(docs, representatives(some), join)
    classes = some.groupBy("class").agg(F.min("doc_id").alias("id"))
    labels = classes.join(comp.withColumnRenamed("node", "id"), "id", "left")
    labels = written(labels.select("class", F.coalesce("component", "id").alias("component_id")), "labels")
    linked = some.select("doc_id", "n_shingles", "class").join(labels, "class").drop("class")
    alone = signed.where("class is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
