"""Best-fit packing by hierarchical residual rounds.

Pieces of at most `size` tokens are dealt to tasks, each packs its own by best fit (longest first) and gives out bins
that are nearly full. Underfull bins become items of the next round over fewer tasks (a tree), until one level is left.
Bins carry their pieces (at most `size`, since a piece has a token or more), so no join is needed.

Defined results: a null text is empty (its end id alone); rows with the same doc_id, null too, are documents of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, prepare, released, slices, written
from .tokens import encoder

SIZE = 2048
#: A bin that lacks no more than this counts as nearly full.
SLACK = 16
#: Items that a task packs together, and tasks whose underfull bins meet in the next round.
BLOCK_ITEMS, FAN_IN = 65536, 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = f"{PIECES}, sequence_id long, offset long"
BINS = "fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def _pieces(vocabulary: str, end_id: int, size: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), as_bytes(column(part, "text"))):
                    ids = encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[at : at + 4 * size]
                        rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return released(run)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the open bin that it leaves least room in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r: a bin with room r is open
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        room -= n
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ITEMS):
                part = batch.slice(at, BLOCK_ITEMS)
                if rows and rows + part.num_rows > BLOCK_ITEMS:
                    yield from _packed(pa.Table.from_batches(held), size)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from _packed(pa.Table.from_batches(held), size)

    return released(run)


def _packed(table: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    lengths = table.column("fill").to_pylist()
    bins = best_fit(lengths, size)
    order = pa.array([i for b in bins for i in b], pa.int64())
    lists = table.column("members").combine_chunks().take(order)
    sizes = np.diff(lists.offsets.to_numpy())
    ends = np.cumsum([len(b) for b in bins]) - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)[ends]]).astype(np.int32)
    fills = np.add.reduceat(np.asarray(lengths)[order.to_numpy()], np.concatenate([[0], ends[:-1] + 1]))
    members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.flatten())
    whole = pa.record_batch([pa.array(fills, pa.int32()), members], ["fill", "members"])
    for at in range(0, whole.num_rows, 2000):
        yield whole.slice(at, 2000)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: pieces of a bin lie one behind the other."""
    for batch in batches:
        lists, numbers = column(batch, "members"), column(batch, "sequence_id").to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        lengths = flat.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        first = np.cumsum(sizes) - sizes
        offset = before - np.repeat(before[first], sizes) if len(before) else before
        fields = [flat.field(k) for k in range(5)]
        yield pa.record_batch([*fields, pa.array(np.repeat(numbers, sizes)), pa.array(offset)], [*(f.name for f in MEMBER), "sequence_id", "offset"])


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, end_id, size), PIECES)


def pack(items: DataFrame, size: int = SIZE, slack: int = SLACK) -> DataFrame:
    """items (as `pieces` gives them) with sequence_id and offset."""
    member = F.struct(*[F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
    bins = items.select(F.col("length").cast("int").alias("fill"), F.array(member).alias("members"))
    full = F.col("fill") >= size - slack
    done = [bins.where(F.col("fill") == size)]
    rest, count = bins.where(F.col("fill") < size), None
    while True:
        if count is None:
            count = rest.count()
            tasks = max(1, -(-count // BLOCK_ITEMS))
        made = written(rest.repartition(tasks).mapInArrow(_pack(size), BINS), "bins")
        left = made.where(~full)
        fewer = left.count()
        if tasks == 1 or fewer == 0 or (tasks <= -(-fewer // BLOCK_ITEMS) and fewer > 0.95 * count):
            done.append(made)
            break
        done.append(made.where(full))
        rest, count, tasks = left, fewer, max(1, min(-(-tasks // FAN_IN), -(-fewer // BLOCK_ITEMS)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # written rows are read in a fixed order, so a repeated task gives a bin the same number
    return out.select(F.monotonically_increasing_id().alias("sequence_id"), "members").mapInArrow(released(_place), PLACED)


def best_fit_packing(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Every document's pieces with their places in sequences of at most `size` tokens."""
    return pack(written(pieces(docs, vocabulary, end_id, size), "pieces"), size)
