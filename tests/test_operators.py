import datetime as dt
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillsift.functions import scalars
from quillsift.functions import text as T
from quillsift.operators import arrange, content, hierarchy, relate, vectors
from quillsift.plans import rank
from quillsift.sources import export, readers
from quillsift.sources.entries import derived, with_paths
from quillsift.streaming import changes


def test_folder_totals(spark):
    """Sums over three levels; a folder of unknown sizes alone has no total, one without files has 0."""
    rows = [(1, None, "shop", True, None), (2, 1, "orders", True, None), (3, 2, "may.csv", False, 70), (4, 2, "june.csv", False, None), (5, 2, "old", True, None), (6, 5, "april.csv", False, 9), (7, 1, "scans", True, None), (8, 7, "s1.tiff", False, None), (9, 7, "s2.tiff", False, None), (10, 1, "drafts", True, None), (11, 1, "logo.svg", False, 5)]
    entries = derived(with_paths(spark.createDataFrame([(*r, None, None) for r in rows], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))
    got = {r.id: r.total for r in hierarchy.folder_totals(entries).collect()}
    assert got == {1: 84, 2: 79, 5: 9, 7: None, 10: 0}
    assert [r.name for r in hierarchy.empty_folders(entries).collect()] == ["drafts"]
    assert {r.name for r in entries.where(hierarchy.path_tail(["orders", "old", "april.csv"])).collect()} == {"april.csv"}


def test_work_files(spark):
    names = {"": True, ".env": True, "~lock.odt": True, "0123456789abcdef_x.bin": True, "2024010112345678.csv": False, "app.LOG": True, "x.pdb": True, "a.db-wal": True, "a.exe.bak-1": True, "plan.docx": False, "abcdef.txt": False, "README": False}
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("low", F.lower("name"))
    got = {r.name: r.w for r in df.select("name", hierarchy.work_file(F.col("low"), T.extension(F.col("name"), F.lit(False))).alias("w")).collect()}
    assert got == names


def test_a_pattern_stays_on_its_line(spark):
    df = spark.createDataFrame([("licensed\nunder it",), ("is licensed under it",), ("b\nc",), ("bxc",), (None,)], "text string")
    hits = lambda q: [r.text for r in df.where(content.matches(F.col("text"), content.pattern(q))).collect()]
    assert hits(r"re:licensed\sunder") == ["is licensed under it"] and hits("re:b[^x]c") == [] and hits("re:^b") == ["b\nc", "bxc"]


def grams(text):
    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower())
    three = {t[i : i + 3] for i in range(len(t) - 2) if all(" " <= c <= "~" for c in t[i : i + 3])}
    han = [c if "\u4e00" <= c <= "\u9fff" else None for c in t]
    return three | {c for c in han if c} | {a + b for a, b in zip(han, han[1:]) if a and b}


TEXTS = ["The Cat  sat\n on", "报告 2024 年报", "", "ab", "é abc é", "tab\tand\x01ctl abc", "aaa aaa"]


def test_grams(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", content.grams(F.col("t")).alias("g")).collect()
    for r in rows:
        assert set(r.g) == grams(r.t) and len(r.g) == len(set(r.g)), r.t


@pytest.mark.parametrize("query", ["cat sat", '"cat sat"', "cat|abc", "zzz | abc", r"re:c.t", "报告"])
def test_pruned_equals_unpruned(spark, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    distinct, _ = content.contents(docs, "doc_id", "text")
    all_of = lambda index: sorted(r.text for r in content.search(distinct, index, query).collect())
    assert all_of(content.postings(distinct)) == all_of(None)


def test_patterns():
    assert content.pattern('a "b c" | d|e') == [["a", "b c"], ["d"], ["e"]]
    assert content.pattern("a b | a") == [["a"]]  # what has a and b has a
    with pytest.raises(ValueError):
        content.pattern(" ".join(f"w{i}" for i in range(40)))


def test_occurrences_and_context(spark):
    docs = spark.createDataFrame([(1, "aXa aaa\nb\nA\nc\nd")], "doc_id long, text string")
    rows = content.lines(docs, "doc_id", "text")
    got = sorted((r.line, r.start) for r in content.occurrences(rows, ["a"]).collect())
    assert got == [(0, 0), (0, 2), (0, 4), (0, 5), (0, 6), (2, 0)]
    assert sorted((r.line, r.start) for r in content.occurrences(rows, ["aa"]).collect()) == [(0, 4)]
    shown = relate.context(rows.withColumn("section", (F.col("line") >= 3).cast("int")), F.col("text") == "A", 1)
    assert sorted(r.line for r in shown.collect()) == [1, 2]


def test_as_of_and_sections(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "doc long, line long")
    b = spark.createDataFrame([(1, 2, "p1"), (1, 5, "p2")], "doc long, line long, place string")
    assert sorted((r.doc, r.line, r.place) for r in relate.as_of(a, b, "doc", "line", "place").collect()) == [(1, 1, None), (1, 5, "p2"), (2, 9, None)]


def test_decay_is_the_recurrence(spark):
    day, times = 86400, [0, 3, 3.5, 20]
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=t)) for t in times], "k long, ts timestamp")
    got = relate.decayed(rows, F.lit("2024-01-25 00:00:00").cast("timestamp"), 14 * day, ["k"]).first().weight
    w, last = 0.0, 0
    for t in times:
        w, last = w * 2 ** (-(t - last) / 14) + 1, t
    assert abs(got - w * 2 ** (-(24 - last) / 14)) < 1e-9


def test_passages_and_vectors(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "a" * 400 + "\n\nb"), (3, None)], "doc_id long, text string")
    got = [(r.file, r.passage, len(r.text)) for r in vectors.passages(docs, "doc_id", "text").orderBy("file", "passage").collect()]
    assert got == [(1, k, 1000) for k in range(5)] + [(2, 0, 400), (2, 1, 1)]
    best = vectors.best_per_file(spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (2, 0, 0.6)], "file long, passage int, score double")).orderBy("file").collect()
    assert [(r.file, r.passage, round(r.score, 6)) for r in best] == [(1, 1, 0.71), (2, 0, 0.6)]


def test_passages_of_whole_texts(spark):
    text = "\n\n".join(f"{i:03}" + "x" * 697 for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = vectors.passages(docs, "doc_id", "text").orderBy("passage").collect()
    assert "\n\n".join(r.text for r in got) == text and [r.passage for r in got] == list(range(60))
    assert vectors.passages(docs, "doc_id", "text", limit=48).count() == 48


def test_best_per_file_over_400_passages(spark, tmp_path):
    from quillsift import queries

    rows = [(i, f"f{i // 100}", [(400 - i) / 1000.0 * (((k * 37) % 11 - 5) / 10.0) for k in range(1, 65)]) for i in range(500)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["semantic_best_per_file"](spark, str(tmp_path)).collect()
    assert sorted((r.file, r.passage) for r in got) == [(f"f{i}", 100 * i) for i in range(4)]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.convert(F.lit(100.0), "c", "f").alias("f"), scalars.convert(F.lit(1.0), "mi", "km").alias("km"), scalars.parse_rgb(F.lit("#f00")).alias("rgb"),
        scalars.hsl(scalars.parse_rgb(F.lit("#00ff00")))["h"].alias("h"), scalars.kind_of_text(F.lit("https://a.b/c")).alias("k1"), scalars.kind_of_text(F.lit("C:\\x y")).alias("k2"),
        *[T.size_text(F.lit(n)).alias(f"s{i}") for i, n in enumerate((999, 1000, 1536, 10_240_000, 5 << 30))],
        *[F.unix_seconds(scalars.as_timestamp(F.lit(n))).alias(f"t{i}") for i, n in enumerate((1_700_000_000, 1_700_000_000_000, 1_700_000_000_000_000, 1_700_000_000_000_000_000))],
    ).first()
    assert (row.f, round(row.km, 6), tuple(row.rgb), row.h, row.k1, row.k2) == (212.0, 1.609344, (255, 0, 0), 120.0, "link", "path")
    assert [row[f"s{i}"] for i in range(5)] == ["999 B", "0.98 KB", "1.50 KB", "9.77 MB", "5.00 GB"]
    assert {row[f"t{i}"] for i in range(4)} == {1_700_000_000}
    with pytest.raises(ValueError):
        scalars.convert(F.lit(1), "kg", "m")


def test_readers_and_export(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "b.txt").write_bytes("\ufeffwide".encode("utf-16-le"))
    (tmp_path / "c.txt").write_bytes("报告".encode("gbk"))
    (tmp_path / "d.txt").write_bytes("é".encode())
    got = {r.path[-5:]: r.text for r in readers.texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"a.txt": "hello", "b.txt": "wide", "c.txt": "报告", "d.txt": "é"}
    assert readers.listing(spark, str(tmp_path)).count() == 4
    lines = spark.createDataFrame([("=1+1", 'a"b')], "x string, y string").select(export.csv_line([F.col("x"), F.col("y")]).alias("l")).first().l
    assert lines == "'=1+1,\"a\"\"b\""
    tree = '{"name":"root","children":[{"name":"a","url":"http://a"},{"name":"f","children":[{"name":"b","url":"http://b"}]}]}'
    found = readers.bookmarks(spark.createDataFrame([(tree,)], "json string")).collect()
    assert {(r.title, r.url, r.folder) for r in found} == {("a", "http://a", "root"), ("b", "http://b", "root/f")}


def test_markup(spark):
    html = "<html><head><title>t</title></head><body><!-- no --><p>A &amp; B<br>c<script>x()</script></p></body></html>"
    assert spark.createDataFrame([(html,)], "h string").select(T.markup_text(F.col("h"))).first()[0] == "A & B\nc"


JOURNAL = [(1, 7, 1, "a", "create"), (2, 7, 1, "a", "data"), (3, 7, 1, "a", "data"), (4, 7, 1, "a", "close"), (5, 7, 1, "a", "rename_old"), (6, 8, 1, "x", "create"), (7, 7, 2, "b", "rename_new"), (8, 8, 1, "x", "delete")]


def test_journal_stream(spark, tmp_path):
    for n, part in enumerate((JOURNAL[:5], JOURNAL[5:])):  # a rename over two batches
        spark.createDataFrame(part, "seq long, file_id long, parent_id long, name string, reason string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    schema = "seq long, file_id long, parent_id long, name string, reason string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = changes.changes(stream).writeStream.foreachBatch(changes.upsert_to(str(tmp_path / "table"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    versions = sorted((p for p in (tmp_path / "table").iterdir()), key=lambda p: int(p.name[2:]))
    rows = spark.read.parquet(str(versions[-1])).collect()
    assert [(r.file_id, r.name, r.parent_id) for r in rows] == [(7, "b", 2)]


def test_batches_are_idempotent(spark):
    entries = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "file_id long, name string, parent_id long")
    batch = spark.createDataFrame([(1, "remove", None, None, None, 5, None), (3, "upsert", "c", 0, None, 6, None), (2, "rename", "d", 4, "b", 7, 0)], changes.CHANGE)
    once = changes.applied(entries, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, changes.applied(once, batch).collect())) == [(2, "d", 4), (3, "c", 0)]


class _State:
    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, at):
        self.at = at

    def getCurrentWatermarkMs(self):
        return 0


def test_repeats_open_their_own_windows():
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    state = _State()
    out = pd.concat(list(changes._repeats(("m",), iter([pd.DataFrame({"ts": [at(s) for s in (3, 4, 5, 6, 12, 13)]})]), state)))
    assert out["suppressed"].tolist() == [0, 0, 0, 2, 0]


def test_journal_state_ends_with_its_file():
    record = lambda seq, parent, name, reason: {"seq": seq, "file_id": 5, "parent_id": parent, "name": name, "reason": reason}
    state = _State()
    run = lambda *rows: [tuple(None if pd.isna(x) else x for x in r) for out in changes._apply((5,), iter([pd.DataFrame(rows)]), state) for r in out.itertuples(index=False)]
    assert run(record(1, 8, "peas", "create")) == [(5, "upsert", "peas", 8, None, 1, None)] and state.exists
    assert run(record(2, 8, "peas", "data"), record(3, 8, "peas", "close")) == [(5, "upsert", "peas", 8, None, 2, None)] and not state.exists
    assert run(record(4, 8, "peas", "rename_old")) == [(5, "remove", None, None, "peas", 4, 8)] and state.exists
    assert run(record(5, 9, "beans", "rename_new"), record(6, 9, "beans", "close")) == [(5, "rename", "beans", 9, "peas", 5, 8)] and not state.exists


def test_scope_of_changes(spark):
    rows = [(1, "rename", "in", 7, "a", 1, 3), (2, "rename", "out", 3, "b", 2, 7), (3, "rename", "stays", 7, "c", 3, 7), (4, "upsert", "new", 7, None, 4, None), (5, "upsert", "elsewhere", 3, None, 5, None), (6, "remove", None, None, "d", 6, 7)]
    watched = spark.createDataFrame([(7,)], "folder_id long")
    got = changes.in_scope(spark.createDataFrame(rows, changes.CHANGE), watched).select("file_id", "op").collect()
    assert sorted(map(tuple, got)) == [(1, "upsert"), (2, "remove"), (3, "rename"), (4, "upsert"), (6, "remove")]


def test_streams_of_counts_and_repeats(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 3, 1, 12) + dt.timedelta(seconds=s)
    rows = [(at(s), "m", 1.0) for s in (0, 1, 2, 3, 4, 11)] + [(at(1), "n", 2.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    counted = run(changes.counts(stream, "10 seconds"), "counted", "complete").select("event_type", "n", "total").collect()
    assert sorted(map(tuple, counted)) == [("m", 1, 1.0), ("m", 5, 5.0), ("n", 1, 2.0)]
    shown = run(changes.limited(stream.select(F.col("event_type").alias("message"), "ts")), "limited", "append").collect()
    assert sorted((r.message, r.suppressed) for r in shown) == [("m", 0)] * 4 + [("m", 2), ("n", 0)]


def test_arranged(spark):
    tree = [(1, None, "P:", True, None, 0), (2, 1, "Users", True, None, 0), (3, 2, "ann", True, None, 0), (4, 3, "notes", True, None, 0), (5, 4, "trip", True, None, 0), (6, 5, "far", True, None, 0), (7, 6, "map.svg", False, 1, 50), (8, 3, "map", True, None, 60), (9, 1, ".cache", True, None, 0), (10, 9, "map.exe", False, 1, 40), (11, 1, "mapper.txt", False, 1, 30), (12, 5, "map of rome.txt", False, 1, 20), (13, None, "maps", True, None, 10)]
    entries = derived(with_paths(spark.createDataFrame([(*r, r[5]) for r in tree], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))
    trees = {r.id: r.tree for r in entries.select("id", arrange.tree_folder().alias("tree")).collect()}
    assert [trees[i] for i in (7, 8, 10, 11, 12, 13)] == [5, 3, 9, 1, 5, None]
    assert {r.id for r in entries.where(arrange.low_priority(["far"])).collect()} == {6, 7, 9, 10}
    hits = entries.where("name_folded LIKE 'map%'").withColumn("score", F.lit(1))
    history = spark.createDataFrame([(12, 5), (12, 9), (11, 7), (99, 100)], "id long, opened long")
    got = arrange.arranged(hits, history, ["map"], ["exe"], 10).collect()
    assert [(r.id, r.part) for r in got] == [(12, 0), (11, 0), (10, 1), (8, 2), (7, 2), (13, 4)]
    assert [r.id for r in arrange.inside_first(hits, hierarchy.under([9]), arrange.best(), 3).collect()] == [10, 8, 7]
    assert [r.id for r in arrange.by_folder(entries.where("id in (7, 8, 11, 12)")).collect()] == [11, 8, 12, 7]
    points = hits.select("id", rank.entry_score(F.lit(100), arrange.low_priority(), F.lit(False), ["exe"], arrange.exact_name(["map"])).alias("s"))
    assert {r.id: r.s for r in points.collect()} == {7: 94, 8: 97, 10: 110, 11: 99, 12: 95, 13: 100}
    known = spark.createDataFrame([(7, 50), (10, 1)], "id long, stamp long")
    assert sorted(map(tuple, arrange.to_read(entries, known).collect())) == [(10, "changed"), (11, "new"), (12, "new")]
