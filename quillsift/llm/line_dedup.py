"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. Keys of at least `min_chars` code
points that at least `min_docs` documents hold lose all their lines but those of the largest doc_id that holds them.

A row that loses nothing goes no further than its scan: a bitmap (bounded) of the others tells it apart. A row's list of
lines to drop is found by two 64-bit hashes of its id and text, so rows that share an id, or have none, have lists of
their own. The table of repeated lines is written before it is joined, so that Spark's adaptive skew join splits a line
that very many documents hold.

Defined results: a null text is one empty line; rows with the same doc_id count as documents of their own, and all
those with the largest doc_id keep the line; a null doc_id counts as the smallest; an empty table gives an empty
result; added columns (n_lines, n_dropped) replace columns of the same name, other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, as_bytes, column, prepare, released, slices, spare, text_key, without, written

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the key, None for a key that is too short."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower() folds A-Z only


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, keys = [], []
                for i, text in enumerate(as_bytes(column(part, "text"))):
                    found = {h for line in (text or b"").split(b"\n") if (h := key_hash(line, min_chars))}
                    rows += [i] * len(found)
                    keys += found
                at = pa.array(rows, pa.int32())
                yield pa.record_batch([*[column(part, n).take(at) for n in ("doc_id", "k1", "k2")], pa.array(keys, pa.binary())], ["doc_id", "k1", "k2", "key"])

    return released(run)


def _rebuild(min_chars: int, names: list[str], drops: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, counts, dropped = [], [], []
                for text, drop in zip(as_bytes(column(part, "text")), column(part, drops).to_pylist()):
                    lines = (text or b"").split(b"\n")
                    gone = set(drop or ())
                    stay = [x for x in lines if key_hash(x, min_chars) not in gone] if gone else lines
                    texts.append(b"\n".join(stay) if gone else text)
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                out = {n: column(part, n) for n in names if n != "text"}
                out["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                out |= {"n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
                yield pa.record_batch([out[n] for n in [*names, "n_lines", "n_dropped"]], [*names, "n_lines", "n_dropped"])

    return released(run)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, key) of the lines that a row loses; k1 and k2 are hashes of its doc_id and text."""
    prepare(docs.sparkSession)
    keyed = docs.select("doc_id", *[k.alias(a) for k, a in zip(text_key("doc_id", "text"), ("k1", "k2"))], "text")
    # (row, key) once each, so that counting rows counts documents
    held = written(keyed.mapInArrow(_hashes(min_chars), "doc_id long, k1 long, k2 long, key binary"), "lines")
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_last")).where(F.col("_n") >= min_docs)
    often = written(often.select("key", "_last"), "often")
    return held.join(often, "key").where(~F.col("doc_id").eqNullSafe(F.col("_last"))).select("k1", "k2", "key")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines that stay in text, and n_lines (before) and n_dropped."""
    docs = without(docs, ["n_lines", "n_dropped"])
    # a row's own lines: no more than its text holds
    lists = repeated_lines(docs, min_chars, min_docs).groupBy("k1", "k2").agg(F.collect_set("key").alias("drop"))
    lists = written(lists, "drops")
    a, b, drops = (spare(docs, n) for n in ("_k1", "_k2", "_drop"))
    keys = text_key("doc_id", "text")
    clear, maybe = Filter(lists.select(F.col("k1").alias("h")), lists.count()).split(docs, keys[0])
    joined = maybe.withColumns({a: keys[0], b: keys[1]}).join(lists.toDF(a, b, drops), [a, b], "left").select(*docs.columns, drops)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = joined.mapInArrow(_rebuild(min_chars, docs.columns, drops), f"{schema}, n_lines long, n_dropped long")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return clear.select("*", F.coalesce(lines, F.lit(1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).unionByName(cut)
