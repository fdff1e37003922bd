import hashlib
import re

from quillsift.llm import exact_dedup, line_dedup

SCHEMA = "doc_id long, text string, lang string, kept boolean, n_lines int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", None, 7) for i, t in pairs], SCHEMA)


PAIRS = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "c"), (6, "a b "), (7, "x" * 300_000), (8, "x" * 300_000), (9, "a b"), (9, "a b"), (None, "c"), (None, None), (10, "é b"), (11, "É b")]


def test_exact(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    got = exact_dedup.decisions(rows(spark, PAIRS)).collect()
    assert len(got) == len(PAIRS)
    by = {}
    for i, t in PAIRS:
        by.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by)
    kept = exact_dedup.exact_dedup(rows(spark, PAIRS))
    assert kept.columns == ["doc_id", "text", "lang", "kept", "n_lines"]
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in PAIRS})
    assert exact_dedup.decisions(rows(spark, [])).count() == 0 and exact_dedup.exact_dedup(rows(spark, [])).count() == 0


def test_exact_in_ranges(spark, monkeypatch):
    """With small ranges, the same rows, and only narrow rows that may be repeats above the scan of the texts."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', if(id % 3 = 0, 7, id), if(id > 2900, ' tail', '')) AS text")
    want = {tuple(r) for r in exact_dedup.decisions(docs).collect()}
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 700)
    got = exact_dedup.decisions(docs)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 3000
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == sorted(r[0] for r in want if r[3])


def test_one_smallest_of_equal_ids(spark):
    got = exact_dedup.decisions(rows(spark, [(9, "a")] * 3 + [(10, "a")])).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {4}


def test_bloom_passes_few_unique_rows(spark):
    found = exact_dedup.written(exact_dedup.digests(spark.range(20_000).selectExpr("id AS doc_id", "string(id div 2 + if(id % 2 = 0, 0, id)) AS text")), "t")
    buckets = -(-20_000 * exact_dedup.BITS_PER_ROW // exact_dedup.BUCKET_BITS)
    flagged = exact_dedup.possibly_repeated(found, buckets, exact_dedup.bloom_filter(found, buckets))
    repeats = found.groupBy("sha").count().where("count > 1")
    assert flagged.where("_maybe").join(repeats, "sha").count() == found.join(repeats, "sha").count()
    assert flagged.where("_maybe").join(repeats, "sha", "left_anti").count() < 0.02 * 20_000


def brute_lines(pairs, chars=20, docs=3):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for n, (i, t) in enumerate(pairs):
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, []).append(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= docs and i != max(j for j in held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_lines(spark):
    a, b, c = "This line is quite common here", "ÄÖÜ äöü mixed CASE line ÄÖÜ", "ä" * 19
    pairs = [(1, f"{a}\nown\n {a.upper()}\t"), (2, f"{b}\n{a}"), (3, f"{a}\n{a}"), (4, f"\n{b}\r\n{c}"), (5, f"{b.replace('CASE', 'case')}\n{c}"), (6, c), (7, None), (8, ""), (9, "z\n" * 50_000)]
    got = line_dedup.line_dedup(rows(spark, pairs))
    assert got.columns == ["doc_id", "text", "lang", "kept", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute_lines(pairs)
    assert line_dedup.line_dedup(rows(spark, [])).count() == 0
    twice = line_dedup.line_dedup(rows(spark, [(1, a), (1, a), (1, a), (None, a)])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in twice) == [(0, 1), (1, 0), (1, 0), (1, 0)]


def test_a_very_common_line_is_joined_apart(spark, monkeypatch):
    from quillsift.llm import common

    monkeypatch.setattr(common, "MAX_HOT_KEYS", 1)
    pairs = [(i, "the same line in every document\nline of some documents %d" % (i % 400)) for i in range(2400)]
    got = line_dedup.line_dedup(rows(spark, pairs))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute_lines(pairs)
