import random

from pyspark.sql import functions as F

from quillsift.llm import warc_revisit as w

SCHEMA = "record_id long, url string, warc_date timestamp, warc_type string, http_headers map<string,string>, payload string"


def at(n):
    import datetime

    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


def rows(spark, records):
    return spark.createDataFrame([(i, u, at(t), k, h, p) for i, u, t, k, h, p in records], SCHEMA)


def test_canonical_urls(spark):
    same = ["http://www.A.com:80/x/?b=2&a=1&utm_source=q#top", "https://a.com/x?a=1&b=2", "a.com/x/?a=1&ref=z&b=2"]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(w.canonical_url(F.col("u"))).collect()}
    assert got == {"a.com/x?a=1&b=2"}


def test_against_brute_force(spark):
    rng, records = random.Random(4), []
    for i in range(900):
        url = "http://hot.example.com/" if rng.random() < 0.35 else f"http://h{rng.randrange(30)}.example.com/p"
        kind = rng.choice(["response", "revisit", "request"])
        headers = {k: str(rng.randrange(3)) for k in ("ETag", "Last-Modified", "Set-Cookie", "cache-control") if rng.random() < 0.5}
        records.append((i, None if rng.random() < 0.02 else url, None if rng.random() < 0.02 else rng.randrange(4000), kind, None if rng.random() < 0.05 else headers, f"p{i}"))
    got = {r.revisit_id: r for r in w.with_payload(w.resolve_revisits(rows(spark, records)), rows(spark, records), ["payload"]).collect()}
    assert sorted(got) == [r[0] for r in records if r[3] == "revisit"]
    for i, url, t, kind, headers, _ in records:
        if kind != "revisit":
            continue
        past = [r for r in records if r[3] == "response" and url and t is not None and r[1] == url and r[2] is not None and r[2] < t]
        r = got[i]
        if not past:
            assert (r.original_id, r.status, r.headers, r.payload) == (None, "missing", None, None)
            continue
        o = max(past, key=lambda x: (x[2], x[0]))
        mine, theirs = ({k.lower(): v for k, v in (h or {}).items()} for h in (headers, o[4]))
        both = [(mine[k], theirs[k]) for k in ("etag", "last-modified") if k in mine and k in theirs]
        status = "unverified" if not both else "resolved" if both[0][0] == both[0][1] else "mismatch"
        assert (r.original_id, r.status) == (o[0], status)
        if status == "mismatch":
            assert r.headers is None and r.payload is None
        else:
            assert r.headers == theirs | {k: v for k, v in mine.items() if k in w.PERMITTED} and r.payload == o[5]


def test_odd_rows(spark):
    records = [(1, "http://a/x", 5, "response", {"ETag": "1", "etag": "2"}, None), (2, "http://a/x", 5, "revisit", None, None), (3, "http://a/x", 6, "revisit", {"etag": 'W/1'}, None), (3, "http://a/x", 6, "revisit", {"etag": 'W/1'}, None)]
    got = sorted((r.revisit_id, r.status) for r in w.resolve_revisits(rows(spark, records)).collect())
    assert got == [(2, "missing"), (3, "resolved"), (3, "resolved")]
    assert w.resolve_revisits(rows(spark, [])).count() == 0
