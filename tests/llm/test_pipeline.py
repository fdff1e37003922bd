import importlib

import pytest

import corpus_pipeline as p
from quillsift.llm import packing, tokens, toxicity
from test_decontaminate import brute as brute_hits
from test_dedup import brute_lines
from test_minhash import brute as brute_groups
from test_tokens_files_packing import check_packing, plain


def test_whole_pipeline_against_a_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [x for x, (p1, _, _) in zip(rows, model.score([(t or "").encode() for _, t in rows])) if p1 < 0.5]
    rows = [(i, t) for i, _, _, t in brute_lines(rows)]
    rows = [(i, t) for (i, t), (j, _, c) in zip(rows, brute_groups(rows, 5, 4, 5)) if i == j == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {i for i, _, hit, _ in brute_hits(rows, items) if hit}
    rows = [(i, t) for i, t in rows if i not in gone]
    got = p.run(spark, sf_dir).collect()
    want = {i: [*ids, 0] for (i, _), ids in zip(rows, plain([t for _, t in rows]))}
    check_packing(got, want, packing.SIZE)


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stages_take_odd_rows(spark, sf_dir, name, stage):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z", None, None, None), (3, "word " * 50_000, "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        out = stage(spark, spark.createDataFrame(rows, schema), sf_dir)
        if name != p.STAGES[-1][0]:
            assert out.columns == p.COLUMNS
        assert (out.count() > 0) == bool(rows)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline"} <= names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
    assert tokens.vocabulary().endswith("word_bpe_49k.json")
