import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillsift.llm import divergence as d

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"
TERM = re.compile("[a-z\x80-\U0010ffff]+")


def plain(rows, least, top):
    """The rows by the definition, over whole terms."""
    docs = [(low(t or ""), lang or "", source or "") for t, lang, source in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = Counter(TERM.findall(text))
        df[lang].update(found.keys())
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        every = Counter()
        for s in sources:
            every.update({t: n[lang, s][t] for t in kept})

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in sources}, share(every)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def frame(spark, rows):
    return spark.createDataFrame([(i % 9, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def mixed():
    rng = random.Random(11)
    stems = ["a", "ab", "abc", "abd", "abcd", "abcde", "abcdefgh", "abcdefghi", "é", "éé", "漢字", "漢語", "Zz", "zZ", "\U0001f600x", "averyverylongtermofmanyletters", "averyverylongtermofmanylettersandmore", *(f"rare{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26))]
    rows = []
    for i in range(200):
        words = [rng.choice(stems[:17]) if rng.random() < 0.7 else rng.choice(stems) for _ in range(rng.randrange(30))]
        rows.append((rng.choice([" ", "1", "-", "@", "\n"]).join(words), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s1", None, "Z", "é"])))
    return rows + [(None, None, None), (None, "xx", "only"), ("", "xx", "other"), ("123 456", "yy", "none"), ("w " * 30_000, "en", "s1"), ("x" * 100_000, "en", "s2"), ("é" * 70_001, "en", "s2")]


@pytest.mark.parametrize("least,top", [(30, 50), (3, 4), (1, 1000)])
def test_against_whole_terms(spark, least, top):
    assert told(d.divergence(frame(spark, mixed()), least, top)) == plain(mixed(), least, top)


def test_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "HELD", 7)
    monkeypatch.setattr(d, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(d, "BLOCK_TERMS", 3)
    monkeypatch.setattr(d, "BLOCK_SOURCES", 2)
    assert told(d.divergence(frame(spark, mixed()), 3, 50)) == plain(mixed(), 3, 50)


def test_refinement_drops_rare_prefixes_before_their_terms(spark):
    rows = [(f"common rare{chr(97 + i)}tail", "en", "s") for i in range(20)]
    held = d.counted_terms(frame(spark, rows))
    assert [tuple(r) for r in d.kept_terms(held, 20).collect()] == [("en", "common")]
    first = held.select("lang", "terms").mapInArrow(d._level(4, None), "lang string, prefix binary, open boolean, docs long")
    assert {bytes(r.prefix) for r in first.collect()} == {b"comm", b"rare"}
    known = d._bitmap(first.where("prefix = cast('comm' AS binary)").limit(1), 1)
    second = held.select("lang", "terms").mapInArrow(d._level(8, spark.sparkContext.broadcast(known)), "lang string, prefix binary, open boolean, docs long")
    assert {bytes(r.prefix) for r in second.collect()} == {b"common"}


def test_repeated_rows_and_empty_table(spark):
    rows = [("one two", "en", "a")] * 3 + [("one", "en", "b")]
    assert told(d.divergence(frame(spark, rows), 3, 5)) == plain(rows, 3, 5)
    assert d.divergence(frame(spark, rows).limit(0)).count() == 0


def test_shares_are_whole_numbers_of_any_size(spark):
    n = 9_000_000_000_000_001
    row = spark.range(1).select(d._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)
