"""Source divergence audit: how far each source's use of a language's common terms lies from the other sources'.

The terms of a language that occur in at least `least` of its documents are found by iceberg prefix refinement. Level by
level, byte prefixes of the documents' terms are counted by distinct documents. A term that ends within a level's length
is counted whole; a longer one counts for its prefix, and where fewer than `least` documents hold that prefix none of
its terms can be kept, so it goes no further. Levels double in length and end when no prefix is left, so that the long
tail of rare terms is never grouped by its full spelling.

Prefixes that go on reach the next level's tasks as a bitmap of their hashes, MAX_BITS (16 MB) at most. A bit that
stands for another prefix lets more terms be counted and never fewer: a kept term is decided by its own exact count.
Beyond some 16 million open prefixes of one level the bitmap prunes less, and the level's groups grow towards those of
all terms; the result stays the same. Counts are summed in batches inside tasks before anything is shuffled.

Terms: `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z in lower case.

Defined results: a null text, lang or source counts as ''; each row is a document of its own, also where rows share a
doc_id; a source without terms is compared with all counts 0; a language without kept terms has pairs of value 0 and no
term rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, column, groups, prepare, released, slices, written
from .shingles import mix

#: Documents of a language that a kept term occurs in, rank of the last term told of a group, the smoothing count, and the scale of p.
LEAST, TOP, EXTRA, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of the first level's prefixes; each further level has twice as many.
FIRST = 4
#: Bits for each open prefix in a level's bitmap, and bits at most.
BITS_EACH, MAX_BITS = 16, 1 << 27
#: Entries that a task counts before it hands them on.
HELD = 500_000
#: Terms of a language in a block of the comparison, and sources on either side of it.
BLOCK_TERMS, BLOCK_SOURCES = 512, 256

_BREAKS = bytes(32 if i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_BREAKS).split() if text else []


def _packed(values: list[bytes]) -> bytes:
    """Terms hold no blank, so one stands between them."""
    return b" ".join(values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their distinct terms, how often each occurs, and a number that deals rows of one group evenly."""
    row = 0
    for batch in batches:
        for part in slices(batch, "text"):
            names, times = [], []
            for text in as_bytes(column(part, "text")):
                found = Counter(terms(text))
                names.append(_packed(list(found)))
                times.append(list(found.values()))
            salts = (np.arange(row, row + part.num_rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            row += part.num_rows
            yield pa.record_batch([column(part, "lang"), column(part, "source"), pa.array(names, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(salts)], ["lang", "source", "terms", "times", "salt"])


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _lengths(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value's bytes begin in the array's data, and how many there are."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return offsets[:-1], np.diff(offsets)


def _hashes(values: pa.Array, seeds: np.ndarray, most: int | None = None) -> np.ndarray:
    """A hash of each value's first `most` bytes (of all), none of them empty; for bitmaps alone, where a clash drops nothing."""
    start, n = _lengths(values)
    if not len(n):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[start[0] : start[-1] + n[-1]]
    place = np.arange(len(data)) - np.repeat(start - start[0], n)
    powers = np.cumprod(np.full(int(n.max()), _FACTOR, np.uint64))
    letters = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    if most is not None:
        letters[place >= most] = 0
    return mix(np.add.reduceat(letters, start - start[0]) + seeds)


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * 8)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


class _Flat:
    """A batch's terms one after another, with the number of the row that each is in."""

    def __init__(self, batch: pa.RecordBatch):
        lists = pc.ascii_split_whitespace(column(batch, "terms").cast(pa.string()))
        self.terms, self.row = lists.flatten().cast(pa.binary()), pc.list_parent_indices(lists).to_numpy()
        self.langs = column(batch, "lang").dictionary_encode()
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.seeds = _seeds(self.langs.dictionary.to_pylist())[self.lang]
        self.keep(_lengths(self.terms)[1] > 0)  # a row without terms has an empty one

    def keep(self, mask: np.ndarray) -> None:
        self.terms, self.row = self.terms.filter(pa.array(mask)), self.row[mask]

    def hashes(self, most: int | None = None) -> np.ndarray:
        return _hashes(self.terms, self.seeds[self.row], most)

    def of(self, values: pa.Array, rows: np.ndarray) -> pa.Array:
        """The value of each row given, as text."""
        return values.take(pa.array(rows)).cast(pa.string())


class _Sums:
    """Counts by key that a task adds up, and hands on where there are many keys."""

    def __init__(self, keys: list[str], value: str):
        self.keys, self.value, self.parts, self.n = keys, value, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.parts.append(table)
        self.n += table.num_rows
        if self.n >= HELD:
            total = self._total()
            self.parts, self.n = [total], total.num_rows
            if self.n >= HELD // 2:
                yield from self.rest()

    def _total(self) -> pa.Table:
        made = pa.concat_tables(self.parts).group_by(self.keys).aggregate([(self.value, "sum")])
        return made.select([*self.keys, f"{self.value}_sum"]).rename_columns([*self.keys, self.value])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._total().to_batches(max_chunksize=1 << 16)
        self.parts, self.n = [], 0


def _level(length: int, bits):
    """Documents of each prefix of `length` bytes (open) and of each term that ends within it and not within half of it."""
    half = length // 2 if bits is not None else 0

    def counted(flat: _Flat, terms: pa.Array, rows: np.ndarray, more: bool) -> pa.Table:
        each = pa.table({"row": pa.array(rows), "prefix": terms})
        if more:  # several terms of a document may share a prefix
            each = each.group_by(["row", "prefix"]).aggregate([])
        codes = pa.array(flat.lang[each["row"].to_numpy()])
        made = pa.table({"code": codes, "prefix": each["prefix"].combine_chunks()}).group_by(["code", "prefix"]).aggregate([([], "count_all")])
        n = made.num_rows
        langs = flat.langs.dictionary.take(made["code"].combine_chunks()).cast(pa.string())
        return pa.table({"lang": langs, "prefix": made["prefix"], "open": pa.array(np.full(n, more)), "docs": made["count_all"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(["lang", "prefix", "open"], "docs")
        for batch in batches:
            for part in slices(batch, "terms"):
                flat = _Flat(part)
                if bits is not None:
                    flat.keep(_lengths(flat.terms)[1] > half)
                    flat.keep(_held(bits.value, flat.hashes(half)))
                longer = _lengths(flat.terms)[1] > length
                yield from sums.add(counted(flat, flat.terms.filter(pa.array(~longer)), flat.row[~longer], False))
                yield from sums.add(counted(flat, pc.binary_slice(flat.terms.filter(pa.array(longer)), 0, length), flat.row[longer], True))
        yield from sums.rest()

    return released(run)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = column(batch, "lang").dictionary_encode()
        seeds = _seeds(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
        at = _hashes(column(batch, "prefix"), seeds) % np.uint64(MAX_BITS)
        yield pa.record_batch([pa.array(at.astype(np.int64))], ["at"])


def _bitmap(prefixes: DataFrame, n: int) -> np.ndarray:
    """The hashes of n (lang, prefix) as bits; their number is a power of two, MAX_BITS at most."""
    bits = min(MAX_BITS, max(1 << 15, 1 << (BITS_EACH * n).bit_length()))
    at = F.pmod("at", F.lit(bits))
    rows = prefixes.select("lang", "prefix").mapInArrow(_hashed, "at long").groupBy(F.floor(at / 32768).alias("b")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # MAX_BITS bounds it
        out[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, times, salt), a row for each row of docs."""
    prepare(docs.sparkSession)
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*blank, "text").mapInArrow(released(_counted), "lang string, source string, terms binary, times array<int>, salt long")
    return written(rows, "terms")


def kept_terms(held: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) in at least `least` documents, by refinement of prefixes; `held` as counted_terms gives it."""
    spark, length, bits, kept = held.sparkSession, FIRST, None, []
    while True:
        level = held.select("lang", "terms").mapInArrow(_level(length, bits), "lang string, prefix binary, open boolean, docs long")
        level = written(level.groupBy("lang", "prefix", "open").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least), "prefixes")
        kept.append(level.where("not open").select("lang", F.col("prefix").cast("string").alias("term")))
        n = level.where("open").count()
        if not n:
            break
        bits = spark.sparkContext.broadcast(_bitmap(level.where("open"), n))
        length *= 2
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return written(out, "kept")


def _occurrences(bits):
    """Occurrences of the terms that the bitmap may hold, by (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(["lang", "source", "term"], "n")
        for batch in batches:
            for part in slices(batch, "terms"):
                flat = _Flat(part)
                times = column(part, "times").flatten().to_numpy()
                held = _held(bits.value, flat.hashes())
                flat.keep(held)
                sources = column(part, "source").dictionary_encode()
                group = flat.lang * part.num_rows + sources.indices.to_numpy(zero_copy_only=False)
                made = pa.table({"group": pa.array(group[flat.row]), "term": flat.terms, "n": pa.array(times[held].astype(np.int64))})
                made = made.group_by(["group", "term"]).aggregate([("n", "sum")])
                code = made["group"].to_numpy()
                langs = flat.langs.dictionary.take(pa.array(code // part.num_rows)).cast(pa.string())
                named = sources.dictionary.take(pa.array(code % part.num_rows)).cast(pa.string())
                yield from sums.add(pa.table({"lang": langs, "source": named, "term": made["term"], "n": made["n_sum"]}))
        yield from sums.rest()

    return released(run)


def occurrences(held: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the kept terms that occur in a group. Rows are dealt by ranges of their groups, so that a
    task adds up few groups, and a large group has many tasks."""
    bits = held.sparkSession.sparkContext.broadcast(_bitmap(kept.select("lang", F.col("term").cast("binary").alias("prefix")), kept.count()))
    dealt = held.repartitionByRange("lang", "source", "salt").drop("salt")
    rows = dealt.mapInArrow(_occurrences(bits), "lang string, source string, term binary, n long")
    rows = rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))
    return written(rows.join(kept, ["lang", "term"]), "occurrences")


def _share(count, total, size):
    """1 + floor(SCALE (count + EXTRA) / (total + EXTRA size)), in whole numbers."""
    wide = lambda c: c.cast("decimal(30,0)")
    above, below = wide(F.lit(SCALE)) * wide(count + F.lit(EXTRA)), wide(total) + wide(F.lit(EXTRA)) * wide(size)
    return (F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)")) + F.lit(1)).cast("long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, block, i, j) to the sums of |p - q| of each pair of sources (a on side i, b on side j) over
    the block's terms that occur on either side, and the number of those terms."""

    def compared(key: tuple, rows: pa.Table):
        side, p = (rows.column(c).to_numpy() for c in ("own", "p"))
        source, term = rows.column("source").to_pylist(), rows.column("term").to_pylist()
        none = np.array([t is None for t in term])
        places = {t: i for i, t in enumerate(dict.fromkeys(t for t in term if t is not None))}
        tables, names = {}, {}
        for s in {key[2], key[3]}:
            own = np.flatnonzero(side == s)
            zero = {source[i]: p[i] for i in own if none[i]}
            names[s] = list(zero)
            at = {x: i for i, x in enumerate(names[s])}
            made = np.repeat(np.array(list(zero.values()), np.int64)[:, None], len(places), axis=1)
            here = own[~none[own]]
            made[[at[source[i]] for i in here], [places[term[i]] for i in here]] = p[here]
            tables[s] = made
        one, two = key[2], key[3]
        for i, a in enumerate(names[one]):
            f = np.abs(tables[two] - tables[one][i]).sum(axis=1)
            for j, b in enumerate(names[two]):
                if a != b and (one != two or a < b):
                    yield key[0], a, b, int(f[j]), len(places)

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["lang", "a", "b", "f", "met"])

    for key, rows in groups(batches, ["lang", "block", "i", "j"]):
        yield out(list(compared(key, rows)))


def _pairs(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, a, b, value) of different sources of a language, each pair once. shares are (lang, source, term, p), sources
    (lang, source, zero, size, sources): zero is p of a count of 0, size the language's kept terms."""
    sides, blocks = F.ceil(F.col("sources") / BLOCK_SOURCES), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_TERMS))
    place = sources.where("sources > 1").select("lang", "source", "zero", sides.alias("sides"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), sides).alias("own"))
    place = written(place, "places")
    empty = place.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "term": F.lit(None).cast("string"), "p": F.col("zero")})
    full = shares.join(place, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    columns = ["lang", "block", "own", "sides", "source", "term", "p"]
    dealt = full.select(*columns).unionByName(empty.select(*columns)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    dealt = dealt.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "source", "term", "p")
    met = dealt.repartition("lang", "block", "i", "j").sortWithinPartitions("lang", "block", "i", "j")
    sums = met.mapInArrow(released(_blocks), "lang string, a string, b string, f long, met long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("met").alias("met"))
    of = lambda x: sources.select("lang", F.col("source").alias(x), F.col("zero").alias(f"zero_{x}"), *(["size"] if x == "a" else []))
    rest = (F.col("size") - F.col("met")) * F.abs(F.col("zero_a") - F.col("zero_b"))
    return sums.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"]).select("lang", "a", "b", (F.col("f") + rest).alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group (lang, source).

    Part `pair` has each other source of the language with the sum of |p - q| over all kept terms; part `term` the `top`
    kept terms of the group that it uses more than its language does, by p - q. p is 1 + floor(SCALE (count + EXTRA) /
    (N + EXTRA V)). Ranks go by value downwards, then by the item's UTF-8 bytes."""
    held = counted_terms(docs)
    kept = kept_terms(held, least)
    found = occurrences(held, kept)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = held.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size"])
    whole = every.groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("sources"))
    every = every.join(whole, "lang").withColumn("zero", F.when(F.col("size") > 0, _share(F.lit(0), F.col("total"), F.col("size"))).otherwise(F.lit(0)))
    every = written(every, "groups")
    shares = found.join(every, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("size")))
    shares = written(shares.select("lang", "source", "term", "p", "all", "size"), "shares")
    everywhere = written(found.groupBy("lang", "term").agg(F.sum("n").alias("everywhere")), "everywhere")
    above = shares.join(everywhere, ["lang", "term"]).withColumn("value", F.col("p") - _share(F.col("everywhere"), F.col("all"), F.col("size"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    half = written(_pairs(shares.select("lang", "source", "term", "p"), every), "pairs")
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(more)
