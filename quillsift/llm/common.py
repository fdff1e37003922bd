"""Shared helpers: written cut points, worker imports, skew-safe joins and text decoding."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast: every caller proves the bound before it hints.
MAX_HOT_KEYS = 4096
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package (clusters get it by --py-files), and where the
    number of rows in an Arrow batch is Spark's default, lowers it: whole texts can be long."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session that runs on one
    machine (tests) gets a new local folder and a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quillsift/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Rows of narrow tables that a file may hold, and files that a table may have however small it is.
FILE_ROWS, FEW_FILES = 1 << 20, 16


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, so that a lost executor costs no recomputation.

    Where a bound of its rows is known (`most`), a table of few rows gets few files."""
    path = new_folder(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(max(FEW_FILES, -(-most // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skew_safe_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of many rows with a table that has each key once and its number of rows in column `count`.

    Keys with more than total / MAX_HOT_KEYS rows are hot. There are at most MAX_HOT_KEYS of them because the
    counts sum to `total`, so that part of the table is broadcast and their rows never meet in one task; the
    other keys are joined by shuffle.
    """
    limit = max(1000, -(-total // MAX_HOT_KEYS))
    hot = table.where(F.col(count) > limit)
    cold = table.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops columns (any case) that an operator is about to add, so that clashing names are replaced."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def spare(df: DataFrame, name: str) -> str:
    """A name that df has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns: together they stand for their values, at a chance of 2^-128 a pair to be equal."""
    names = [F.col(c) for c in columns]
    return [F.xxhash64(*names), F.xxhash64(F.lit(11), *names)]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def released(run):
    """Wraps a batch function so that a worker gives its spare memory back after each task."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Cuts a batch into runs of rows with about `most` bytes of text each (one row at least)."""
    sizes = _sizes(column(batch, text))
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def groups(batches, names: list[str]):
    """(key, rows) of each run of equal `names` in batches that are sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(column(batch, n).to_pylist() for n in names)))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo] != group:
                yield group, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            group = keys[lo]
    if held:
        yield group, pa.Table.from_batches(held)


def _sizes(array: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_pylist()


#: Bits of a filter at most (16 MB); beyond it more rows pass, never fewer.
MAX_FILTER_BITS = 1 << 27


class Filter:
    """A bitmap of 64-bit hashes, 16 bits for each of `total` and MAX_FILTER_BITS at most, as a table (_bucket, _bits)."""

    def __init__(self, hashes: DataFrame, total: int):
        """hashes have one column, h."""
        self.buckets = max(1, min(MAX_FILTER_BITS, 16 * total) // 32768)
        bucket, place = self._place(F.col("h"))
        rows = hashes.select(bucket.alias("_bucket"), place.alias("_at"))
        self.table = written(rows.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), "filter")

    def _place(self, h: Column) -> tuple[Column, Column]:
        place = F.pmod(h, F.lit(self.buckets * 32768))
        return F.floor(place / 32768), F.pmod(place, F.lit(32768))

    def split(self, rows: DataFrame, h: Column) -> tuple[DataFrame, DataFrame]:
        """Rows that the filter rules out, and rows that it may hold. Both go no further than their scan; a null h is ruled out."""
        b, bits, at = (spare(rows, n) for n in ("_bucket", "_bits", "_at"))
        bucket, place = self._place(h)
        table = self.table.withColumnsRenamed({"_bucket": b, "_bits": bits})
        joined = rows.withColumns({b: bucket, at: place}).join(F.broadcast(table), b, "left")  # MAX_FILTER_BITS bounds it
        octet = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = F.coalesce(F.bit_get(octet, F.pmod(F.col(at), F.lit(8)).cast("int")) == 1, F.lit(False))
        return joined.where(~held).select(*rows.columns), joined.where(held).select(*rows.columns)


def drop_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (one column, each id once). Only rows that a filter of the ids may
    hold are shuffled."""
    gone = written(gone.toDF("gone"), "gone")
    clear, maybe = Filter(gone.select(F.xxhash64("gone").alias("h")), gone.count()).split(docs, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")))
    name = spare(docs, "_gone")
    return clear.unionByName(maybe.join(gone.toDF(name), F.col("doc_id") == F.col(name), "left_anti"))
