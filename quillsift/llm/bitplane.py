"""Token ids in files of bit planes.

A file holds the ids of a run of documents in ascending doc_id order. Blocks of BLOCK ids are transposed into bit planes
(or byte planes), each plane is compressed with zstandard, planes of zeros take no room, and a chunk index and a document
index close the file:

    magic | planes of block 0 | planes of block 1 | ... | footer (zstandard) | footer length (u32) | magic
    footer: kind (u8: 1 bits, 8 bytes), documents (u64), blocks (u32),
            blocks x [offset u64, ids u32], blocks x planes x [length u32],
            doc_id i64 each, known u8 each, ids of each document u32

Documents are dealt by ranges of doc_id (and of a hash of the text, so that rows without an id are dealt too). A task
closes a file at FILE_IDS ids or FILE_DOCS documents and goes on with the next, so files and what a writer holds have a
bound; only one document may go beyond it. Every attempt of a task writes names of its own and gives out a row for each
file; the rows of the attempt that counts are the list of files (one for 64 MB of ids), and no file is ever renamed or
written over. Readers take one file at a time, its chunk index first and then one block after the other.

Defined results: a null text is empty (the end id alone); null doc_ids come first; rows with the same doc_id are
documents of their own, in the order of a hash of their text; an empty table makes no file and gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, column, prepare, released, slices
from .tokens import encoder

MAGIC = b"QSBITPL1"
BLOCK = 16384
SUFFIX = "qsbp"
#: Ids (64 MB of them) and documents that close a file.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; a plane of zeros is empty."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = []
    for k in range(4):
        one = np.ascontiguousarray(octets[:, k])
        if not one.any():
            planes += [b""] * (8 if bits else 1)
        elif bits:
            planes += [row.tobytes() if row.any() else b"" for row in np.packbits(np.unpackbits(one[:, None], axis=1, bitorder="little").T, axis=1)]
        else:
            planes.append(one.tobytes())
    return planes


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    width = 8 if bits else 1
    for k in range(4):
        group = planes[k * width : (k + 1) * width]
        if not any(group):
            continue
        if bits:
            rows = np.zeros((8, -(-n // 8)), np.uint8)
            for j, plane in enumerate(group):
                if plane:
                    rows[j] = np.frombuffer(plane, np.uint8)
            octets[:, k] = np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1, bitorder="little")[:, 0]
        else:
            octets[:, k] = np.frombuffer(group[0], np.uint8)
    return octets.view("<u4")[:, 0]


class Writer:
    """Writes one file; holds no more than a block and the document index."""

    def __init__(self, out, bits: bool = True, level: int = 3):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.buffer, self.held = [], 0
        self.index, self.lengths, self.docs, self.counts, self.total = [], [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.buffer)
        end = len(data) if last else len(data) // (4 * BLOCK) * (4 * BLOCK)
        for at in range(0, end, 4 * BLOCK):
            ids = np.frombuffer(data, "<u4", min(BLOCK, (end - at) // 4), at)
            packed = [self.zip.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
            self.index.append((self.at, len(ids)))
            self.lengths.append([len(p) for p in packed])
            for p in packed:
                self.out.write(p)
            self.at += sum(map(len, packed))
        self.buffer, self.held = [data[end:]], len(data) - end

    def close(self) -> int:
        """Ends the file and gives its number of ids."""
        self._flush(True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        footer = struct.pack("<BQI", 1 if self.bits else 8, len(self.docs), len(self.index))
        footer += b"".join(struct.pack("<QI", *x) for x in self.index) + np.array(self.lengths, "<u4").tobytes()
        footer += np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes() + np.array(self.counts, "<u4").tobytes()
        packed = self.zip.compress(footer)
        self.out.write(packed + struct.pack("<I", len(packed)) + MAGIC)
        return self.total


class Reader:
    """Reads one file: any block alone by the chunk index, or document by document. Holds the indexes and a block."""

    def __init__(self, file):
        """file can be read and sought (pyarrow's input files and buffers can)."""
        self.file = file
        end = file.seek(0, 2)
        head, tail = self._at(0, 8), self._at(max(0, end - 12), 12)
        if head != MAGIC or tail[-8:] != MAGIC:
            raise ValueError("not a bit-plane file")
        (n,) = struct.unpack("<I", tail[:4])
        self.unzip = zstandard.ZstdDecompressor()
        footer = self.unzip.decompress(self._at(end - 12 - n, n))
        kind, docs, blocks = struct.unpack_from("<BQI", footer)
        self.bits, planes, at = kind == 1, 32 if kind == 1 else 4, 13
        self.blocks = [struct.unpack_from("<QI", footer, at + 12 * i) for i in range(blocks)]
        at += 12 * blocks
        self.lengths = np.frombuffer(footer, "<u4", blocks * planes, at).reshape(blocks, planes)
        at += 4 * blocks * planes
        ids = np.frombuffer(footer, "<i8", docs, at).tolist()
        known = np.frombuffer(footer, np.uint8, docs, at + 8 * docs).tolist()
        self.docs = [i if k else None for i, k in zip(ids, known)]
        self.counts = np.frombuffer(footer, "<u4", docs, at + 9 * docs).tolist()

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        place, n = self.blocks[k]
        sizes = self.lengths[k].tolist()
        data, planes, at = memoryview(self._at(place, sum(sizes))), [], 0
        for size in sizes:
            planes.append(self.unzip.decompress(data[at : at + size]) if size else b"")
            at += size
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids); keeps one document and one block in memory."""
        start, k, held = 0, 0, np.zeros(0, "<u4")
        for doc_id, n in zip(self.docs, self.counts):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            data = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, start, data[:n]
            held, start = data[n:], start + n


def _write(path: str, vocabulary: str, end_id: int, bits: bool, most: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, attempt = encoder(vocabulary).encode, TaskContext.get().partitionId(), uuid.uuid4().hex
        store, folder = fs.FileSystem.from_uri(path)
        writer, out, name, made = None, None, "", 0

        def closed() -> pa.RecordBatch:
            n = writer.close()
            out.close()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array([x], t) for x, t in zip((shard, made, name, n), kinds)], ["shard", "file", "name", "n_ids"])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), as_bytes(column(part, "text"))):
                    if writer is None:
                        name = f"part-{shard:06d}-{made:06d}-{attempt}.{SUFFIX}"
                        out = store.open_output_stream(f"{folder}/{name}")
                        writer = Writer(out, bits)
                    writer.add(doc_id, encode(text) + end)
                    if writer.total >= most or len(writer.docs) >= FILE_DOCS:
                        yield closed()
                        writer, made = None, made + 1
        if writer is not None:
            yield closed()

    return released(run)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, bits: bool = True, file_ids: int = FILE_IDS) -> list[tuple[str, int]]:
    """Encodes docs (doc_id, text) into files under path; gives (name, ids) of each file in order."""
    prepare(docs.sparkSession)
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(_write(path, vocabulary, end_id, bits, file_ids), "shard long, file long, name string, n_ids long")
    return [(r.name, r.n_ids) for r in sorted(made.collect())]  # a row for each 64 MB of ids


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, before in zip(column(batch, "name").to_pylist(), column(batch, "before").to_pylist()):
                with store.open_input_file(f"{folder}/{name}") as file:
                    rows = []
                    for doc_id, start, ids in Reader(file).documents():
                        rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return released(run)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under path."""
    prepare(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *[n for _, n in files]])[:-1].tolist()
    # a row and a task for each file
    listed = spark.createDataFrame(list(zip([name for name, _ in files], before)), "name string, before long")
    tasks = max(1, min(len(files), 10_000))
    return listed.repartition(tasks).mapInArrow(_read(path), schema)
