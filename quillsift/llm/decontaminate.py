"""Benchmark decontamination by winnowing.

Documents and benchmark items are sequences of words. Of each run of WINDOW consecutive K-gram hashes the least is kept
as a fingerprint, so two texts that share WINDOW + K - 1 = 10 words in a row share a fingerprint there. A fingerprint
carries the hashes of the words around it that a window of 10 can reach. An item of fewer than 10 words is one window;
its whole run is its fingerprint, and documents keep every run of that length.

Fingerprints of documents are first held against a bitmap of the items' (bounded, it never loses one) inside the scan.
Those that pass are joined with the items' by value; each pair is extended to both sides along the words they carry.
Windows of 10 words hold a fingerprint each, so the extended pairs cover every shared span of any length. Texts never
move: equal texts are one, by two 64-bit hashes, and equal items too. The join stands above two scans, so that Spark's
adaptive skew join splits a passage that very many documents hold.

Defined results: a null text has no words; an item without words has no window; an item with a null item_id counts for
hits and is not listed; items that share an item_id are one item; equal rows get equal results; empty tables work; extra
columns of any name pass through unread. decontaminate() decides by each row's own text: rows that share a doc_id, or
have none, stay or go one by one. Words are compared by 64-bit hashes, ten in a row or all of a shorter item's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, as_bytes, column, prepare, released, slices, spare, text_key, written
from .shingles import _get as word_hash
from .shingles import mix, runs

LENGTH, K = 10, 5
WINDOW = LENGTH - K + 1
#: Word hashes that a fingerprint carries: those a window of LENGTH words around it can reach.
REACH = LENGTH - K
SPAN = K + 2 * REACH
#: Bits of the bitmap of the items' fingerprints: 16 for each, at least and at most so many.
MIN_BITS, MAX_BITS = 1 << 22, 1 << 27

#: Every byte that is no word character becomes a space, A-Z lower case.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window (the last of equals), each place once."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def fingerprints(h: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, values, places) of word hashes: winnowed K-grams (n = 0), and every run of n words for each n of `lengths`."""
    if len(h) >= LENGTH:
        grams = runs(h, K)
        at = winnow(grams, WINDOW)
        yield 0, mix(grams[at]), at
    for n in lengths:
        if len(h) >= n:
            yield n, mix(runs(h, n) + np.uint64(n)), np.arange(len(h) - n + 1)


def around(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """SPAN word hashes for each place, REACH of them before it; 0 where the text has none."""
    padded = np.concatenate([np.zeros(REACH, np.uint64), h, np.zeros(SPAN, np.uint64)])
    return padded[places[:, None] + np.arange(SPAN)]


def extended(n: np.ndarray, place: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each pair of fingerprints holds a window, and the start and end of its run of equal words."""
    same = (mine == theirs) & (mine != 0)
    left = np.cumprod(same[:, REACH - 1 :: -1] if REACH else same[:, :0], axis=1).sum(axis=1)
    right = np.cumprod(same[:, REACH:], axis=1).sum(axis=1)
    short = n > 0
    left = np.where(short, 0, left)
    right = np.where(short, np.where(right >= n, n, 0), right)
    return np.where(short, right > 0, (right >= K) & (left + right >= LENGTH)), place - left, place + right


FOUND = "array<struct<n:int,value:bigint,place:int,words:binary>>"
_FOUND = pa.list_(pa.struct([("n", pa.int32()), ("value", pa.int64()), ("place", pa.int32()), ("words", pa.binary())]))


def _marks(lengths, bits):
    """Texts to their number of words and their fingerprints, those that `bits` may hold where it is given."""

    def found(h: np.ndarray) -> list[dict]:
        out = []
        for n, values, places in fingerprints(h, lengths.value):
            if bits is not None:
                at = values % np.uint64(len(bits.value) * 8)
                held = bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0
                values, places = values[held], places[held]
            near = around(h, places) if len(places) else ()
            out += [{"n": n, "value": v, "place": p, "words": w.tobytes()} for v, p, w in zip(values.view(np.int64).tolist(), places.tolist(), near)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            for part in slices(batch, "text"):
                sizes, marks = [], []
                for text in as_bytes(column(part, "text")):
                    h = hashes(words_of(text))
                    sizes.append(len(h))
                    marks.append(found(h))
                yield pa.record_batch([*[column(part, x) for x in names], pa.array(sizes, pa.int64()), pa.array(marks, _FOUND)], [*names, "n_words", "found"])

    return released(run)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, theirs = (np.frombuffer(b"".join(column(batch, x).to_pylist()), np.uint64).reshape(-1, SPAN) for x in ("words", "item_words"))
        good, start, end = extended(column(batch, "n").to_numpy(), column(batch, "place").to_numpy(), mine, theirs)
        keep = pa.array(good)
        yield pa.record_batch([*[column(batch, x).filter(keep) for x in ("k1", "k2")], pa.array(start[good], pa.int32()), pa.array(end[good], pa.int32()), column(batch, "item").filter(keep)], ["k1", "k2", "start", "end", "item"])


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bits of the values, MAX_BITS at most (16 MB)."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * values.count()).bit_length()))
    place = F.col("value").bitwiseAND(F.lit(bits - 1))
    rows = values.groupBy(F.floor(place / 32768).alias("b")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # MAX_BITS bounds it
        out[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, n, value, item_words) of the fingerprints of different item texts, and (item, ids) of each of those texts."""
    shared = benchmark.sparkSession.sparkContext.broadcast
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", *[k.alias(a) for k, a in zip(text_key("text"), ("k1", "k2"))]).where("text is not null")
    once = written(texts.groupBy("k1", "k2").agg(F.any_value("text").alias("text")), "items")
    item = F.concat_ws(":", "k1", "k2").alias("item")
    # texts of LENGTH words and more are winnowed; a shorter one has the one run of its own length
    marks = once.select(item, "text").mapInArrow(_marks(shared(list(range(1, LENGTH))), None), f"item string, n_words long, found {FOUND}")
    rows = marks.select("item", "n_words", F.explode("found").alias("f")).select("item", "n_words", "f.*")
    rows = rows.where("CASE WHEN n_words >= 10 THEN n = 0 ELSE n = n_words END").select("item", "n", "value", F.col("words").alias("item_words"))
    ids = texts.where("item_id is not null").groupBy(item).agg(F.collect_set("item_id").alias("ids"))
    return written(rows, "fingerprints"), written(ids, "item-ids")


def _hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words) of every row, and (k1, k2, spans, items) of the texts that hold a window."""
    spark = docs.sparkSession
    prepare(spark)
    prints, ids = _items(benchmark)
    lengths = [r.n for r in prints.where("n > 0").select("n").distinct().collect()]  # 9 at most
    shared = spark.sparkContext.broadcast
    keyed = docs.select("doc_id", *[k.alias(a) for k, a in zip(text_key("text"), ("k1", "k2"))], "text")
    marks = keyed.mapInArrow(_marks(shared(sorted(lengths)), shared(_bitmap(prints.select("value").distinct()))), f"doc_id long, k1 long, k2 long, n_words long, found {FOUND}")
    marks = written(marks, "marks")
    some = marks.where("size(found) > 0").groupBy("k1", "k2").agg(F.any_value("found").alias("found"))
    mine = written(some.select("k1", "k2", F.explode("found").alias("f")).select("k1", "k2", "f.*"), "candidates")
    pairs = mine.join(prints, ["n", "value"])
    spans = written(pairs.mapInArrow(released(_extend), "k1 long, k2 long, start int, end int, item string"), "spans")
    # a text's own spans and items: no more than it has fingerprints that items share
    names = spans.select("k1", "k2", "item").distinct().join(ids, "item").select("k1", "k2", F.explode("ids").alias("id"))
    names = names.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("items"))
    own = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    hits = own.join(names, ["k1", "k2"], "left").select("k1", "k2", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    merged = hits.mapInArrow(released(_merge), "k1 long, k2 long, spans array<struct<start:int,end:int>>, items array<string>")
    return marks.select("doc_id", "k1", "k2", "n_words"), written(merged, "hits")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans to the maximal runs that they cover."""
    for batch in batches:
        out = []
        for spans in column(batch, "spans").to_pylist():
            runs_: list[dict] = []
            for s in spans:
                if runs_ and s["start"] <= runs_[-1]["end"]:
                    runs_[-1]["end"] = max(runs_[-1]["end"], s["end"])
                else:
                    runs_.append(dict(s))
            out.append(runs_)
        yield pa.record_batch([column(batch, "k1"), column(batch, "k2"), pa.array(out, _SPANS), column(batch, "items")], ["k1", "k2", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of docs: spans [start, end) of hit words, ids of items as strings."""
    rows, hits = _hits(docs, benchmark)
    clear, maybe = Filter(hits.select(F.col("k1").alias("h")), hits.count()).split(rows, F.col("k1"))
    none = [F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")]
    found = maybe.join(hits, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    return clear.select("doc_id", "n_words", none[0].alias("spans"), none[1].alias("items")).unionByName(found)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no window of the benchmark; only rows that a filter may hold are shuffled."""
    hits = _hits(docs, benchmark)[1]
    keys = text_key("text")
    clear, maybe = Filter(hits.select(F.col("k1").alias("h")), hits.count()).split(docs, keys[0])
    a, b = spare(docs, "_k1"), spare(docs, "_k2")
    gone = hits.select(F.col("k1").alias(f"{a}g"), F.col("k2").alias(f"{b}g"))
    maybe = maybe.withColumns({a: keys[0], b: keys[1]})
    stay = maybe.join(gone, (F.col(a) == F.col(f"{a}g")) & (F.col(b) == F.col(f"{b}g")), "left_anti")
    return clear.unionByName(stay.select(*docs.columns))
