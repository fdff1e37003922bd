import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillsift.llm import bitplane, packing, tokens
from quillsift.llm.common import new_folder

ODD = ["", "  ", "Hello, World's 12 dogs!", "ÀÉ straße Ωμέγα ΣΑΣ İx", "a<|endoftext|>b", "x\x1cy\x1dz", "日本語 текст 12ab's", "é café", "a b c", "~~ ''s 're", "\x00a \x7fb"]


def plain(texts):
    t = Tokenizer.from_file(tokens.vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_encoder_equals_the_library(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    e = tokens.encoder(tokens.vocabulary())
    for text, ids in zip(texts, plain(texts)):
        assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == ids, text[:80]


@pytest.mark.parametrize("bits,most", [(True, 1 << 24), (False, 40)])
def test_files_round_trip(spark, bits, most):
    texts = [*ODD, None, "word " * 9000]
    docs = rows(spark, texts).unionByName(spark.createDataFrame([(None, "null id")], "doc_id long, text string"))
    path = new_folder(spark, "t")
    files = bitplane.write_ids(docs, path, tokens.vocabulary(), 2, bits, most)
    assert most > 40 or len({name[:11] for name, _ in files}) < len(files)  # with the small one, files are rolled
    got = bitplane.read_back(spark, path, files).orderBy("start").collect()
    order = [None, *range(len(texts))]
    want = [[*ids, 2] for ids in plain(["null id", *texts])]
    start = 0
    assert [r.doc_id for r in got] == order
    for r, ids in zip(got, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_rows_that_share_an_id_or_have_none(spark):
    docs = spark.createDataFrame([(i, t) for i in (None, 3) for t in (None, "a", "a", "b c")], "doc_id long, text string")
    path = new_folder(spark, "t")
    got = bitplane.read_back(spark, path, bitplane.write_ids(docs, path, tokens.vocabulary())).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 4 + [3] * 4 and sorted(r.n_tokens for r in got[:4]) == sorted(r.n_tokens for r in got[4:])
    packed = packing.best_fit_packing(docs, tokens.vocabulary()).collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0] * 4 + [3] * 4 and len({(r.sequence_id, r.offset) for r in packed}) == 8


def test_planes_of_large_ids():
    ids = np.array([0, 1, 2**32 - 1, 70000, 5], "<u4")
    for bits in (True, False):
        assert bitplane.from_planes(bitplane.to_planes(ids, bits), 5, bits).tolist() == ids.tolist()


def test_files_of_nothing(spark):
    path = new_folder(spark, "t")
    assert bitplane.read_back(spark, path, bitplane.write_ids(rows(spark, []), path, tokens.vocabulary())).count() == 0


def check_packing(got, want, size):
    """Every id once, sequences gapless and within the size."""
    pieces = {(r.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    for doc_id, ids in want.items():
        cuts = [ids[i : i + size] for i in range(0, len(ids), size)]
        for k, cut in enumerate(cuts):
            r = pieces.pop((doc_id, k))
            assert (r.start, r.length, r.ids_crc32) == (k * size, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)))
    assert not pieces
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, sf_dir):
    texts = [*ODD, None, "word " * 5000, *[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]]
    got = packing.best_fit_packing(rows(spark, texts), tokens.vocabulary()).collect()
    want = {i: [*ids, 0] for i, ids in enumerate(plain(texts))}
    n = check_packing(got, want, packing.SIZE)
    assert n <= 1.05 * -(-sum(map(len, want.values())) // packing.SIZE) + 1
    assert packing.best_fit_packing(rows(spark, []), tokens.vocabulary()).count() == 0


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 50)
    items = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + (id * 37) % 1500 AS length", "id AS ids_crc32")
    got = packing.pack(items).collect()
    total = sum(r.length for r in got)
    assert len({(r.doc_id) for r in got}) == 1000
    assert len({r.sequence_id for r in got}) <= 1.12 * total / packing.SIZE + 1


def test_best_fit():
    bins = packing.best_fit([5, 7, 3, 5, 10], 10)
    assert sorted(sorted(b) for b in bins) == [[0, 3], [1, 2], [4]]
