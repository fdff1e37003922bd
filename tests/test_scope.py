"""Folders as they are named: places of a search, rules that hide, where a typed path leads, what was chosen before."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillsift.operators import scope
from quillsift.sources.entries import derived, with_paths

TREE = [
    (1, None, "D:", True), (2, 1, "music", True), (3, 2, "jazz", True), (4, 3, "Live", True), (5, 4, "take.flac", False), (6, 3, "take.flac", False),
    (7, 1, "old", True), (8, 7, "Music", True), (9, 8, "live", True), (10, 9, "encore.flac", False), (11, None, "E:", True), (12, 11, "live music", True), (13, 12, "set.txt", False), (14, 11, "jazz club", True), (15, 14, "live", True), (16, 15, "bill.txt", False),
]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(*r, 10 * r[0], 1_600_000_000 + r[0], 0) for r in TREE]
    return derived(with_paths(spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long"))).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_words_and_places():
    split = lambda t: (lambda r: (r[0], [(p.path, p.names) for p in r[1]]))(scope.split_scope(t))
    assert split("take live/") == ("take", [("", ("live",))]) and split("Jazz\\Live/ take") == ("take", [("", ("jazz", "live"))])
    assert split("take /live") == ("take", [("", ("live",))]) and split("/live") == ("/live", []) and split("/live take") == ("/live take", [])
    assert split('"D:\\My Music\\" take') == ("take", [("d:\\my music", ())]) and split("take D:\\music") == ("take", [("d:\\music", ())])
    assert split('"live/" take') == ('"live/" take', []) and split("!live/ l*/ re:a/ /") == ("!live/ l*/ re:a/ /", [])
    assert split("a/ b/ c") == ("c", [("", ("a",)), ("", ("b",))]) and split("live/ /jazz") == ("/jazz", [("", ("live",))])
    assert split("歌／ take") == ("take", [("", ("歌",))]) and split("") == ("", [])


def test_places_are_read_exactly_then_approximately_then_as_words(entries):
    def read(text, **more):
        found = scope.resolve(entries, text, **more)
        return found.words, list(found.readings.values()), None if found.folders is None else ids(found.folders)

    assert read("take live/") == ("take", ["exact"], [4, 9, 15]) and read("take music/live/") == ("take", ["exact"], [9])
    assert read("take usic/liv/") == ("take", ["approximate"], [4, 9]) and read("take club/live/") == ("take", ["approximate"], [15])
    assert read("take nowhere/") == ("take nowhere/", ["words"], None)
    assert read("take D:\\old\\") == ("take", ["path"], [7]) and read("take D:\\new\\") == ("take", ["missing"], [])
    old = F.exists("folders", lambda x: x == "old") | (F.col("name_folded") == "old")
    assert read("take live/", aside=old)[2] == [4, 15] and read("take old/", aside=old)[2] == [7]


def test_inside(spark, entries):
    folders = spark.createDataFrame([(3,), (15,)], "id long")
    assert ids(scope.inside(entries, folders)) == [4, 5, 6, 16]


def test_approximate_places_are_bounded(spark):
    rows = [(0, None, "D:", True)] + [(i, 0, f"album {i}", True) for i in range(1, 300)]
    many = derived(with_paths(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))
    assert ids(scope.resolve(many, "x lbum/").folders) == list(range(1, scope.APPROXIMATE + 1))


@pytest.mark.parametrize(
    "rules,gone",
    [([], []), (["LIVE"], [4, 5, 9, 10, 15, 16]), (["music\\live"], [9, 10]), (["jazz/live"], [4, 5]), (["l*"], [4, 5, 9, 10, 12, 13, 15, 16]), (["D:\\music"], [2, 3, 4, 5, 6]), (["music"], [2, 3, 4, 5, 6, 8, 9, 10]), (["D:\\"], [*range(1, 11)]), (["d:\\*\\jazz"], [3, 4, 5, 6]), (["ol?", "jazz club\\live"], [7, 8, 9, 10, 15, 16]), (["take.flac"], [])],
)
def test_rules_hide_folders_and_all_in_them(entries, rules, gone):
    got = {r.id: r.reason for r in scope.shown(entries, rules).collect()}
    assert sorted(i for i, r in got.items() if r == "folder") == gone and set(got.values()) <= {"folder", "shown"} and len(got) == len(TREE)


def test_what_both_rules_skip_is_in_no_set(entries):
    got = {r.id: r.reason for r in scope.shown(entries, ["live"], F.col("ext") == "flac").collect()}
    assert sorted(set(range(1, 17)) - set(got)) == [5, 10] and got[6] == "file" and got[16] == "folder" and got[13] == "shown"


def test_files_are_not_exploded(entries):
    plan = scope.shown(entries, ["live"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the folders over their ancestors


def test_path_leads(spark, entries):
    none = spark.createDataFrame([], "id long, opened long")
    aside = F.coalesce(F.get("folders", F.lit(1)) == "old", F.lit(False))
    lead = lambda typed, history=none, **more: [r.id for r in scope.path_leads(entries, typed, history, aside, 1_700_000_000, **more).collect()]
    assert lead("live/") == [15, 4, 9] and lead("music/") == [2, 8] and lead("jazz\\take.flac") == [6] and lead("take.flac/") == []
    opened = spark.createDataFrame([(9, 50), (9, 90), (4, 80)], "id long, opened long")
    assert lead("live", opened) == [9, 4, 15] and lead("take.flac", folders_only=True) == []
    assert [r.id for r in scope.path_leads(entries, "take.flac", none, F.lit(False), 1_599_000_000).collect()] == [6, 5]  # times ahead of now are unknown


def test_learned_first(spark):
    now = dt.datetime(2024, 5, 1)
    hits = spark.createDataFrame([(i, 50 + i, 1000 + i) for i in range(1, 9)], "id long, score int, modified long")
    day = lambda n: now - dt.timedelta(days=n)
    visits = [(1, "rep", day(0)), (2, "report", day(0)), (2, "report", day(1)), (3, "re", day(0)), (4, None, day(0)), (4, None, day(0)), (5, "rep", day(60)), (6, "xyz", day(0)), (7, "rep", day(13)), (7, "rep", day(13)), (7, "rep", day(13)), (7, "rep", day(13)), (7, "rep", day(12))]
    rows = spark.createDataFrame(visits, "id long, text string, ts timestamp")
    got = scope.learned_first(hits, rows, "REP", F.lit(str(now)).cast("timestamp"), 7).collect()
    # 7 weighs 2.5 at most and so more than 1; then a longer text, a shorter one, the entities alone; 5 was too long ago
    assert [r.id for r in got] == [7, 1, 2, 3, 4, 6, 8] and [r.learned for r in got] == [True] * 6 + [False]
    assert {r.id: r.score for r in got} == {7: 300 + 75, 1: 340, 2: 300 + 47, 3: 324, 4: 300 + 32, 6: 320, 8: 58}
