"""Near-duplicates: universal hash minima with banding, signature and full-set verification, connected components.

Documents with the same set of word shingles are one class; only a class's smallest doc_id goes on. Its minima are cut
into bands; in each bucket of a band every member is compared with the bucket's smallest id (a star, so that rows grow
with a group's size, not its square): first by signature, then by the full sets. What the stars of all bands leave in
different components of one bucket is compared in blocks inside tasks, which give out links alone. A block holds BLOCK
documents or BLOCK_SHINGLES shingles; a bucket's smallest id has met the others in its star, and of buckets with the
same members one is enough. Every pair of documents that shares a bucket is so compared or already in one component.

Joins on ids and bucket keys stand right above scans of written tables: Spark's adaptive skew join splits hot ones.

Defined results: a null or blank text has an empty set and is linked with nothing; a null doc_id is linked with nothing
and stays, with a null component; rows that share a doc_id are one document that has each of their texts; an empty
table gives an empty result; added columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, as_bytes, column, drop_ids, prepare, released, slices, written
from .components import components
from .shingles import MinHash, shingle_set

ROWS = 4
#: Chance that no band of a pair at the threshold agrees, and that its signature is taken for one below it.
MISS = 1e-6
#: Documents of one bucket that a task compares with as many others, and shingles of them (16 MB), about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21


class Plan:
    """Shingle length, the threshold num/den, and the bands and signature bound that go with it."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        s = num / den
        self.bands = math.ceil(math.log(MISS) / math.log(1 - s**ROWS))
        self.size = self.bands * ROWS
        tail, self.least = 0.0, 0
        for m in range(self.size + 1):
            tail += math.comb(self.size, m) * s**m * (1 - s) ** (self.size - m)
            if tail > MISS:
                self.least = m
                break

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * self.den < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both * self.den >= self.num * (len(a) + len(b) - both)


def _sign(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHash(plan.size)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, classes, bands, sigs = [], [], [], []
                for text in as_bytes(column(part, "text")):
                    values = shingle_set(text, plan.k)
                    sizes.append(len(values))
                    if len(values):
                        sig = minima.signature(values)
                        classes.append(xxhash.xxh3_128_digest(values.tobytes()))
                        bands.append(minima.bands(sig, ROWS).view(np.int64))
                        sigs.append(sig.astype(np.uint8).tobytes())
                    else:
                        classes.append(None), bands.append(None), sigs.append(None)
                yield pa.record_batch(
                    [column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "class", "bands", "sig"],
                )

    return released(run)


def _similar(plan: Plan):
    """Pairs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(column(batch, x).to_pylist()), np.uint8).reshape(-1, plan.size) for x in ("sig_a", "sig_b"))
            n, m = (column(batch, x).to_numpy() for x in ("n_a", "n_b"))
            good = ((a == b).sum(axis=1) >= plan.least) & (np.minimum(n, m) * plan.den >= plan.num * np.maximum(n, m))
            yield pa.record_batch([column(batch, x).filter(pa.array(good)) for x in ("a", "b")], ["a", "b"])

    return released(run)


def _verify(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(column(batch, "values_a"), column(batch, "values_b"))
            good = pa.array([plan.linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both)) for both in sets], pa.bool_())
            yield pa.record_batch([column(batch, x).filter(good) for x in ("a", "b")], ["u", "v"])

    return released(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([column(part, "id"), pa.array([shingle_set(t, k).tobytes() for t in as_bytes(column(part, "text"))], pa.binary())], ["id", "values"])

    return released(run)


def block_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], plan: Plan, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between documents of different components, one for each pair of components at most; with `side`, only
    links between documents of different sides."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1  # a value that one document has adds to no intersection
    names, col = np.unique(place[shared], return_inverse=True)
    rows = owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    for at in range(0, len(names), 4096):
        lo, hi = np.searchsorted(col, (at, at + 4096))
        x = np.zeros((len(sets), min(4096, len(names) - at)), np.float32)
        x[rows[lo:hi], col[lo:hi] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    union = n[:, None] + n[None, :] - both
    good = np.triu(plan.den * both >= plan.num * union, 1) & (comps[:, None] != comps[None, :])
    if side is not None:
        good &= side[:, None] != side[None, :]
    return list({(int(comps[i]), int(comps[j])): (int(ids[i]), int(ids[j])) for i, j in np.argwhere(good)}.values())


def _blocks(plan: Plan):
    """Rows come sorted by (key, i, j): the members of blocks i and j of a bucket."""

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        if rows.num_rows < 2:
            return []
        rows = rows.combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("values")]
        ids, comps, side = (rows.column(c).to_numpy() for c in ("id", "component", "own"))
        met = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()  # pairs within a block meet in (i, i)
        return block_links(ids, comps, sets, plan, side if met else None)

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([column(batch, c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(keys[lo]) != group:
                    found += links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                group = tuple(keys[lo])
            yield out(found)
        if held:
            yield out(links(pa.Table.from_batches(held)))

    return released(run)


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_sign(plan), "doc_id long, n_shingles long, class binary, bands array<long>, sig binary")


def _shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, values) of the ids, each text of an id once: a filter at the scan leaves the other texts unshuffled."""
    ids = written(ids, "ids")
    rows = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null and doc_id is not null")
    some = Filter(ids.select(F.xxhash64("id").alias("h")), ids.count()).split(rows, F.xxhash64("id"))[1]
    texts = some.join(ids, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"))
    return written(texts.select("id", "text").mapInArrow(_sets(k), "id long, values binary"), "sets")


def _star_links(docs: DataFrame, reps: DataFrame, buckets: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) between the members of buckets and their smallest ids."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    pairs = buckets.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = written(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_similar(plan), "a long, b long"), "pairs")
    sets = _shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), plan.k)
    of = lambda x: sets.select(F.col("id").alias(x), F.col("values").alias(f"values_{x}"))
    return written(pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_verify(plan), "u long, v long"), "links")


def _links_left(docs: DataFrame, reps: DataFrame, buckets: DataFrame, comp: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) between documents that share a bucket and that the stars have left in different components."""
    sizes = reps.select("id", "n_shingles")
    own = buckets.where("id <> a").select("id", "band", "key").join(comp.withColumnRenamed("node", "id"), "id", "left")
    own = written(own.join(sizes, "id").withColumn("component", F.coalesce("component", "id")), "members")
    same = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    apart = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), *same)
    apart = written(apart.where("lo < hi").groupBy("n", "m", "lo", "hi", "s0", "s1").agg(F.min("key").alias("key")).select("key", "n", "m"), "apart")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_SHINGLES))
    members = own.join(apart, "key").select("key", "id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("own"))
    members = written(members, "apart")
    sets = _shingle_sets(docs, members.select("id").distinct(), plan.k)
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component").join(sets, "id")
    met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(met.mapInArrow(_blocks(plan), "u long, v long"), "more")


def linked_components(docs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """(node, component) of class representatives (id, n_shingles, bands, sig) that are linked with others."""
    held = reps.select("id", F.posexplode("bands").alias("band", "key"))
    stars = written(held.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a"), "stars")
    buckets = written(held.join(stars, "key"), "buckets")
    comp = written(components(_star_links(docs, reps, buckets, plan)), "components")
    more = _links_left(docs, reps, buckets, comp, plan)
    if more.isEmpty():
        return comp
    return components(more.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def near_dedup(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; links need Jaccard >= num / den."""
    plan = Plan(k, num, den)
    signed = written(signatures(docs, plan), "signed")
    some = signed.where("class is not null and doc_id is not null")
    held = F.struct("n_shingles", "bands", "sig")
    classes = written(some.groupBy("class").agg(F.min("doc_id").alias("id"), F.any_value(held).alias("x")).select("class", "id", "x.*"), "classes")
    comp = linked_components(docs, classes.drop("class"), plan)
    labels = classes.select("class", "id").join(comp.withColumnRenamed("node", "id"), "id", "left")
    labels = written(labels.select("class", F.coalesce("component", "id").alias("component_id")), "labels")
    linked = some.select("doc_id", "n_shingles", "class").join(labels, "class").drop("class")
    alone = signed.where("class is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without all but the smallest doc_id of each component."""
    return drop_ids(docs, near_dedup(docs.select("doc_id", "text"), k, num, den).where("not kept").select("doc_id").distinct())
