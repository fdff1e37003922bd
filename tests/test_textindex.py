"""The index that follows its documents, against one that is built anew; and the log of changes beside it."""

import random

import pytest
from pyspark.sql import functions as F

from quillsift.operators import content
from quillsift.operators.textindex import TextIndex
from quillsift.streaming.changelog import ChangeLog

CHANGE = "doc long, text string, deleted boolean, at long"
WORDS = ["amber", "basalt", "cobalt", "dolomite", "emerald", "flint", "granite 12-34", "花崗岩", "Ambergris", "basalt\tslab", "x"]
SEARCHES = ["amber", "amber cobalt", "amber | flint", r"re:basalt\s(slab|emerald)", "re:granite.*34 | emerald dolomite", "花崗", r"re:\d\d-\d\d", "x", "ambergris|cobalt flint|emerald"]


def made(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changes(rng, n):
    """Changes of one batch, some documents twice in it, some removed, one row without a document."""
    rows = [(rng.randrange(60), made(rng, rng.randrange(9)), rng.random() < 0.2, i) for i in range(n)]
    return [*rows, (rows[0][0], None, False, n + 1), (None, "amber", False, 0)]


def after(texts, batch):
    for doc, text, deleted, _ in sorted((r for r in batch if r[0] is not None), key=lambda r: r[3]):
        if deleted:
            texts.pop(doc, None)
        else:
            texts[doc] = text or ""
    return dict(texts)


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc long, text string")


def same_as_rebuilt(spark, index, texts, searches=SEARCHES):
    docs = docs_of(spark, texts).cache()
    for query in searches:
        want = {r.doc for r in docs.where(content.matches(F.col("text"), content.pattern(query))).collect()}
        assert {r.doc for r in index.search(docs, query).collect()} == want, query
    held = {(r.doc, r.gram) for r in index.postings().select("doc", "gram").collect()}
    built = {(r.doc, r.gram) for r in docs.select("doc", F.explode(content.grams(F.col("text"))).alias("gram")).collect()}
    assert held == built
    docs.unpersist()


def test_batches_merges_and_repeats(spark, tmp_path):
    rng, index, texts = random.Random(7), TextIndex(spark, str(tmp_path / "i")), {}
    assert index.indexed_to == -1 and index.postings() is None and index.hits(content.need([["amber"]])) is None
    for n in range(6):
        batch = changes(rng, 30)
        texts = after(texts, batch)
        index.apply(spark.createDataFrame(batch, CHANGE), n)
        index.apply(spark.createDataFrame(changes(rng, 5), CHANGE), n)  # a repeated batch changes nothing, whatever it holds
        if n == 3:
            index.compact(tail_only=True)
            assert index.segments() == [(0, 0), (1, 3)]
        if n in (0, 2, 3, 5):
            same_as_rebuilt(spark, index, texts, SEARCHES if n == 5 else SEARCHES[1:4])
    index.compact()
    assert index.segments() == [(0, 5)] and index.indexed_to == 5
    same_as_rebuilt(spark, index, texts)
    assert index.spark.read.parquet(f"{index.path}/seg-0-5/versions").where("deleted").count() == 0
    index.vacuum()
    assert index.folder.names() == ["seg-0-5"]
    same_as_rebuilt(spark, index, texts, SEARCHES[:1])


def test_a_writer_that_dies_is_not_read(spark, tmp_path):
    index, texts = TextIndex(spark, str(tmp_path / "i")), {1: "amber", 2: "flint"}
    index.apply(spark.createDataFrame([(d, t, False, 0) for d, t in texts.items()], CHANGE), 0)
    half = spark.createDataFrame([("amb", 9, 1), ("mbe", 9, 1)], "gram string, doc long, seq long")
    half.write.parquet(f"{index.path}/seg-1-1/postings")  # its versions never came
    assert index.segments() == [(0, 0)]
    same_as_rebuilt(spark, index, texts, SEARCHES[:3])
    index.apply(spark.createDataFrame([(2, None, True, 0)], CHANGE), 1)  # the batch runs again
    same_as_rebuilt(spark, index, {1: "amber"}, SEARCHES[:3])


def test_long_tails_are_merged(spark, tmp_path, monkeypatch):
    import quillsift.operators.textindex as t

    monkeypatch.setattr(t, "TAIL", 2)
    index, texts = TextIndex(spark, str(tmp_path / "i")), {i: f"amber {i}" for i in range(20)}
    index.apply(spark.createDataFrame([(d, x, False, 0) for d, x in texts.items()], CHANGE), 0)
    for n in (1, 2, 3):
        texts[n] = "flint"
        index.apply(spark.createDataFrame([(n, "flint", False, 0)], CHANGE), n)
        index.maintain()
    assert index.segments() == [(0, 0), (1, 3)]
    same_as_rebuilt(spark, index, texts, SEARCHES[:3])


def test_a_stream_of_changes_gives_what_a_rebuild_gives(spark, tmp_path):
    """Files arrive one by one; after each the answers are those of an index built anew, also where the index's own
    stream starts over and sees every batch again."""
    rng, texts, source = random.Random(3), {}, tmp_path / "in"
    source.mkdir()
    index = TextIndex(spark, str(tmp_path / "i"))
    log = ChangeLog(spark, str(tmp_path / "log"))

    def run(checkpoint):
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(source))

        def both(batch, number):
            batch.persist()
            log.follow(batch, number)
            index.apply(batch, number)
            batch.unpersist()

        query = stream.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    for n in range(3):
        batch = changes(rng, 25)
        texts = after(texts, batch)
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(str(source))
        run("c1")
        same_as_rebuilt(spark, index, texts, SEARCHES[2:5])
    before = index.segments()
    run("c2")  # a new checkpoint: all batches come again
    assert index.segments() == before and log.batches() == [0, 1, 2]
    same_as_rebuilt(spark, index, texts, SEARCHES[2:5])


def test_an_index_that_lags_behind_is_made_good_by_the_log(spark, tmp_path):
    index, log = TextIndex(spark, str(tmp_path / "i")), ChangeLog(spark, str(tmp_path / "log"), most=3)
    texts = {i: "amber" if i % 2 else "flint" for i in range(10)}
    first = spark.createDataFrame([(d, t, False, 0) for d, t in texts.items()], CHANGE)
    index.apply(first, 0)
    log.append(first, 0)
    read = {}
    for n, touched in enumerate(([1, 2], [2, 4], [6]), start=1):
        for d in touched:
            texts[d] = "amber now" if d % 2 == 0 else "flint now"
        log.append(spark.createDataFrame([(d,) for d in touched], "doc long"), n)
        changed, complete = log.since(index.indexed_to)
        docs = docs_of(spark, texts)
        found = index.search(docs, "amber", changed, complete)
        assert {r.doc for r in found.collect()} == {d for d, t in texts.items() if "amber" in t}
        read[n] = (complete, sorted(r.doc for r in changed.collect()))
    assert read == {1: (True, [1, 2]), 2: (True, [1, 2, 4]), 3: (True, [1, 2, 4, 6])}
    log.trim()  # three changes are kept: batches 2 and 3
    assert log.floor == 1 and log.batches() == [2, 3]
    changed, complete = log.since(0)
    assert not complete and sorted(r.doc for r in changed.collect()) == [2, 4, 6]
    found = index.search(docs_of(spark, texts), "amber", changed, complete)  # everything is looked at, and still right
    assert {r.doc for r in found.collect()} == {d for d, t in texts.items() if "amber" in t}
    assert log.since(1)[1] and log.since(3)[1] and log.since(3)[0].count() == 0


def test_the_log_forgets_what_is_too_much(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), most=5)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc long")
    for n, some in enumerate(([1, 1, 2, None], [2, 3], [4])):
        log.follow(ids(*some), n)
    assert log.floor == -1 and log.since(-1)[0].count() == 4
    log.follow(ids(4), 2)  # again
    assert log.since(1)[0].count() == 1
    log.follow(ids(*range(10, 16)), 3)  # more than is kept by itself
    assert (log.floor, log.batches(), log.since(2)[1], log.since(3)[1], log.last()) == (3, [], False, True, 3)
    log.follow(ids(7), 2)  # late and below the floor
    assert log.batches() == []
    log.follow(ids(8), 4)
    log.renumbered(4)
    assert not log.since(3)[1] and log.since(4)[1] and log.folder.names() == ["floor=4"]


@pytest.mark.parametrize("query,least", [("re:basalt.*cobalt", 1), ("re:(cobalt.*amber|flint.*dolomite)", 1)])
def test_fewer_texts_are_read(spark, tmp_path, query, least):
    rng, texts = random.Random(1), {}
    texts = {i: made(rng, 4) for i in range(200)}
    index = TextIndex(spark, str(tmp_path / "i"))
    index.apply(spark.createDataFrame([(d, t, False, 0) for d, t in texts.items()], CHANGE), 0)
    kept = index.hits(content.need(content.pattern(query))).count()
    found = index.search(docs_of(spark, texts), query).count()
    assert least <= found <= kept < 120


def test_grams_reach_the_scan(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.apply(spark.createDataFrame([(1, "amber", False, 0)], CHANGE), 0)
    plan = index.hits(content.need([["amber"]]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [amb,ber,mbe])" in plan


def test_a_gram_has_lists_of_documents(spark, tmp_path):
    """One row for a gram of a batch, not one for each document that has it."""
    index = TextIndex(spark, str(tmp_path / "i"))
    index.apply(spark.createDataFrame([(i, "amber flint", False, 0) for i in range(400)], CHANGE).coalesce(1), 0)
    rows = spark.read.parquet(f"{index.path}/seg-0-0/postings")
    assert index.postings().count() == 400 * 9 and rows.count() <= 9 * 4  # 9 grams, 4 tasks


@pytest.mark.parametrize("step,most", [(1, 2), (7, 3), (1 << 20, 1 << 10)])
def test_grams_are_whole_where_texts_are_cut(step, most):
    """Windows of a text and of a batch lose no gram and make none up."""
    import pyarrow as pa

    from quillsift.operators import gramlists

    rng = random.Random(5)
    texts = [None, "", "ab", "報告", "é abc é", "x" * 30, "花", *("".join(rng.choice("ab 花崗岩é𠀀\x01~") for _ in range(rng.randrange(40))) for _ in range(60))]
    want = set()
    for i, t in enumerate(texts):
        t = t or ""
        han = ["一" <= c <= "鿿" for c in t]
        want |= {(t[k : k + 3], i) for k in range(len(t) - 2) if all(" " <= c <= "~" for c in t[k : k + 3])}
        want |= {(t[k : k + n], i) for n in (1, 2) for k in range(len(t) - n + 1) if all(han[k : k + n])}
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["key", "text"])
    got = [(g, i) for b in gramlists._lists(step, most)([batch.slice(0, 40), batch.slice(40)]) for g, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in keys]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_search_that_reads_every_text_makes_no_index(spark, sf_dir, monkeypatch):
    from quillsift import indexed, queries

    monkeypatch.setattr(indexed, "text_index", lambda *a: pytest.fail("an index was made"))
    assert queries.QUERIES["content_regex_unpruned"](spark, sf_dir).count() >= 0
