"""Extra columns of any name, and rows that share an id or have none, in every operator that passes columns through."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from quillsift.llm import decontaminate, exact_dedup, language_id, line_dedup, minhash, quality, toxicity, warc_revisit

NAMES = ["_id", "_gone", "_o", "label", "bucket", "bits", "text_a", "_k1", "_k2", "_drop", "_bucket", "_bits", "_at", "_sha", "sha", "_maybe", "_copy", "gone", "h", "key", "id", "k1", "n", "place", "toxic", "quality", "learn", "count", "_share", "LABEL2"]
LINE = "a line that many documents have, one of them twice"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} and some more words of {i}\n{LINE}\nthe end of {i % 7}", "en" if i % 2 else "de") for i in range(40)]
    rows += [(None, rows[3][1], "en"), (None, None, None), (None, "clean", "en"), (5, "another text of id five", "en"), (5, rows[5][1], "de"), (6, rows[6][1], "de"), (41, "x " * 20_000, "en")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return made.withColumns({n: F.lit("extra") for n in NAMES})


def labels(spark, name):
    return spark.createDataFrame([(i, int(i % 3 == 0), "x", "y") for i in range(40)], f"doc_id long, {name} int, label string, _id string")


CASES = {
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "lines": lambda s, d: line_dedup.line_dedup(d),
    "near": lambda s, d: minhash.drop_near_duplicates(d),
    "benchmark": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "some more words of 8", "q"), (None, None, "q")], "item_id long, text string, found string")),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s, "toxic"))),
    "quality": lambda s, d: quality.score(d, quality.fit(d, labels(s, "quality"))),
    "language": lambda s, d: language_id.predict(d, language_id.fit(d)),
}


@pytest.mark.parametrize("case", CASES)
def test_extra_columns_pass_through(spark, docs, case):
    plain = docs.select("doc_id", "text", "lang")
    with_more, without = CASES[case](spark, docs), CASES[case](spark, plain)
    assert with_more.columns[: len(docs.columns)] == docs.columns
    key = lambda r: sorted((str(x.doc_id), str(x.text)) for x in r)
    got = with_more.collect()
    assert key(got) == key(without.collect()) and all(r[n] == "extra" for r in got for n in NAMES)


def test_payload_columns_clash(spark):
    rows = [(1, "u", 0, "response", {"ETag": "1"}, "p"), (2, "u", 5, "revisit", {"ETag": "1"}, None)]
    records = spark.createDataFrame(rows, "record_id long, url string, t long, warc_type string, http_headers map<string,string>, html string")
    records = records.withColumn("warc_date", F.timestamp_seconds("t")).withColumns({n: F.lit("extra") for n in ("_o", "_key", "_ts", "_piece", "status", "original_id")})
    got = warc_revisit.with_payload(warc_revisit.resolve_revisits(records), records, ["html", "status"]).collect()
    assert [(r.status, r.html, r.status_) for r in got] == [("resolved", "p", "extra")]


@pytest.mark.parametrize("name,stage", p.STAGES[:-1])
def test_stages_with_extra_columns(spark, docs, sf_dir, name, stage):
    more = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    assert stage(spark, more, sf_dir).columns == p.COLUMNS
