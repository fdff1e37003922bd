import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import fill_in_middle as fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string"


def plain(doc_id, text, rate=50, suffix_first=80, seed=42):
    """(n, form, prefix_chars, middle_chars, output) token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= rate:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < suffix_first:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(4)
    made = [None, "", " ", " \t\r\n ", "a", "a ", " a", "\x00", "a\x00b c", "a <P> b", "x<M>", "<", "<P", "P>", "<S <P <M", "\x1f\x21 \x08\x0e", "é" * 9 + " " + "漢字 " * 5, "\U0001f600 \U0001f600", "no-break\xa0space", "w " * 60_000, "long" * 50_000]
    for _ in range(300):
        made.append("".join(rng.choice(" \t\n\x0b\x0c\rabcdeé漢\U0001f600<>PSM\x7f\x80") for _ in range(rng.randrange(40))))
    return made


@pytest.mark.parametrize("rate,suffix_first", [(50, 80), (100, 50), (0, 0)])
def test_against_tokens(spark, rate, suffix_first):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a null id is hashed as nothing"), (7, "the same id"), (7, "the same id"), (-3, "below zero is hashed with its sign")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = fim.fill_in_middle(docs, rate, suffix_first)
    got = out.withColumn("back", fim.restored(F.col("fim"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim) for r in got), key=key) == sorted(((i, t, *plain(i, t, rate, suffix_first)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in fim.fill_in_middle(docs).collect()}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.fim) == plain(i, r.text) for i, r in got.items())
    assert {r.form for r in got.values()} == {"plain", "spm", "psm"}


def test_marks_of_every_byte():
    data = np.arange(256, dtype=np.uint8)
    want = [b == 0x20 or 9 <= b <= 13 for b in range(256)]
    words = fim.blanks(data.view("<u8"))
    assert [bool(words[i >> 3] >> np.uint64(8 * (i & 7) + 7) & np.uint64(1)) for i in range(256)] == want


def test_select_finds_each_mark():
    rng = np.random.default_rng(3)
    bits = rng.random(4001) < 0.3
    packed = np.zeros((len(bits) // 8 + 1) * 8, np.uint8)
    packed[: len(bits)][bits] = 0x80
    ranks, places = fim.Ranks(packed.view("<u8").astype(np.uint64)), np.flatnonzero(bits)
    assert (ranks.select(np.arange(1, len(places) + 1)) == places + 1).all()
    assert (ranks.rank(np.arange(len(bits))) == np.concatenate([[0], np.cumsum(bits)[:-1]])).all()


def test_steps_cut_nothing(spark, monkeypatch):
    texts = [t.encode() for t in odd_texts() if t]
    draws = [(i * 7919, i * 104729) for i in range(len(texts))]
    whole = fim.cuts(texts, draws)
    monkeypatch.setattr(fim, "_STEP", 3)
    assert all((x == y).all() for x, y in zip(whole, fim.cuts(texts, draws)))


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "y", 3)], "doc_id long, text string, FIM string, form string, extra int")
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "extra", *fim.ADDED] and out.first().extra == 3
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
