import random
import re

import pytest

from quillsift.llm import decontaminate


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(d, b).collect()
    clean = decontaminate.decontaminate(d, b)
    assert clean.columns == d.columns
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r.items)) for r in rows]
    gone = {r[0] for r in got if r[2]}
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, _ in docs if i not in gone)
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("bits", [1 << 27, 1 << 16])
def test_against_brute_force(spark, sf_dir, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)  # the small one: the bitmap is nearly full
    rng = random.Random(3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    some = [f"v{i}" for i in range(12)]
    for i in range(60):  # few words, many chance meetings
        docs.append((10_000 + i, " ".join(rng.choice(some[: 2 + i % 4]) for _ in range(rng.randrange(60)))))
    for i in range(12):
        items.append((900 + i, " ".join(rng.choice(some[:3]) for _ in range(i + 1))))
    items += [(None, "a nameless item of exactly ten words is this one"), (901, None), (902, "..."), (903, "v0"), (903, "solo")]
    docs += [(None, "SOLO"), (20_000, None), (20_001, ""), (20_002, "x a NAMELESS item, of exactly ten words is this one y"), (20_003, "v1 " * 20_000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_rows_go_one_by_one(spark):
    texts = ["a nameless item of exactly ten words is this one", "another item that has as many words as that one"]
    docs = [(None, f"x {texts[0]}"), (None, "clean"), (None, None), (1, f"{texts[1]} y"), (1, "also clean"), (2, "clean")]
    d = spark.createDataFrame([(i, t, [n]) for n, (i, t) in enumerate(docs)], "doc_id long, text string, more array<long>")
    left = decontaminate.decontaminate(d, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    assert left.columns == d.columns and sorted(r.more[0] for r in left.collect()) == [1, 2, 4, 5]
