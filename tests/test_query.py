import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quillsift import api
from quillsift.plans import query as Q
from quillsift.plans import rank
from quillsift.sources.entries import derived, with_paths

def entry(spark, names):
    rows = [(1, None, "D:", True), (2, 1, "garden", True)] + [(10 + i, 2, n, False) for i, n in enumerate(names)]
    nodes = spark.createDataFrame([(*r, 1000 * r[0], 1_700_000_000 + r[0], 0) for r in rows], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")
    return derived(with_paths(nodes))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def stands_for(mark, name):
    """Whether a name is what * (any run) and ? (any one) stand for."""
    if not mark:
        return not name
    if mark[0] == "*":
        return stands_for(mark[1:], name) or bool(name) and stands_for(mark, name[1:])
    return bool(name) and mark[0] in ("?", name[0]) and stands_for(mark[1:], name[1:])


def a_term(rng, names):
    """A term as it is typed, and what it means for a folded name."""
    whole = rng.choice(names)
    at = rng.randrange(len(whole))
    piece = whole[at : at + rng.randrange(1, 5)]
    word = piece.strip(" .").replace(" ", "") or "x"
    some, kind = low(word), rng.choice(["word", "word", "word", "phrase", "start", "end", "both", "wild", "regex", "ext", "not", "not regex"])
    if kind == "phrase":
        return f'"{piece.strip() or word}"', lambda n: low(piece.strip() or word) in n
    if kind == "start":
        return f"^{word}", lambda n: n.startswith(some)
    if kind == "end":
        return f"{word}$", lambda n: n.endswith(some)
    if kind == "both":
        return f"^{word}$", lambda n: n == some
    if kind == "wild":
        mark = rng.choice([f"*{word}*", f"{word}*", f"*{word}", f"?{word}*", f"*{word}??"])
        return mark, lambda n: stands_for(low(mark), n)
    if kind in ("regex", "not regex"):
        first, last = re.escape(word[0]), re.escape(word[-1])
        text = rng.choice([f"^{first}", f"{last}$", f"{first}.{{0,3}}{last}", f"({first}|{last}) ?\\w", f"[{word[0]}q-z]+\\.", f"{first}+"])
        hit = lambda n: re.search(text, n, re.I) is not None
        typed = f're:"{text}"' if " " in text else f"re:{text}"
        return (typed, hit) if kind == "regex" else (f"!{typed}", lambda n: not hit(n))
    if kind == "ext":
        ends = rng.sample(["yy", "zz", "wyz"], 2)
        return f"ext:{rng.choice([',', ';', '|']).join(ends)}", lambda n: "." in n and n.rpartition(".")[2] in ends
    return (f"!{word}", lambda n: some not in n) if kind == "not" else (word, lambda n: some in n)


@pytest.mark.parametrize("seed", range(4))
def test_matching(spark, seed):
    """Search texts put together from terms whose meaning is told apart from the library's; names share few letters with
    the folder, so that no word is one of a folder."""
    rng = random.Random(seed)
    names = [" ".join("".join(rng.choice("wxyzWXYZ-4") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".yy", ".ZZ", ".wyz", ".z.yy"]) for _ in range(40)]
    names = [n for n in dict.fromkeys(names) if n[0] not in "-"]
    entries = entry(spark, names).where("NOT is_dir").cache()
    cases = []
    while len(cases) < 40:
        ways = [[a_term(rng, names) for _ in range(rng.randrange(1, 4))] for _ in range(rng.choice([1, 1, 2, 3]))]
        cases.append((" | ".join(" ".join(t for t, _ in way) for way in ways), ways))
    hits = [Q.predicate(Q.parse(text), Q.fields()).alias(f"h{i}") for i, (text, _) in enumerate(cases)]
    got = {r.id: r for r in entries.select("id", *hits).collect()}
    wrong = [(text, n) for i, (text, ways) in enumerate(cases) for j, n in enumerate(names) if bool(got[10 + j][f"h{i}"]) != any(all(f(low(n)) for _, f in way) for way in ways)]
    assert not wrong
    assert sum(bool(r[f"h{i}"]) for r in got.values() for i in range(len(cases))) > 40
    entries.unpersist()


@pytest.mark.parametrize("bad", ["a |", "| a", "a | | b", "re:a[", " | ".join("a" * 34)])
def test_errors(bad):
    with pytest.raises(Q.QueryError):
        Q.parse(bad)


def test_sizes_and_times():
    assert Q.parse_size("5mb") == (5 << 20, None) and Q.parse_size(">1k") == (1025, None) and Q.parse_size("1k..2k") == (1024, 2049) and Q.parse_size("nope") is None
    assert Q.parse_size("<=1.5kb") == (0, 1537) and Q.parse_size("empty") == (0, 1)
    now = dt.datetime(2024, 3, 31, 12)
    at = lambda *x: int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp())
    assert Q.parse_time("2024-02", now) == (at(2024, 2, 1), at(2024, 3, 1)) and Q.parse_time(">2024", now) == (at(2025, 1, 1), None)
    assert Q.parse_time("1m", now)[0] == at(2024, 2, 29, 12) and Q.parse_time("thisweek", now)[0] == at(2024, 3, 25) and Q.parse_time("1970", now) is None


def sample(spark):
    """Two roots; names that share a word, a folder of the same word, sizes and times in different orders."""
    t, hour = 1_600_000_000, 3600
    rows = [
        (1, None, "M:", True, None, None), (2, 1, "kitchen", True, None, None), (3, 2, "Soup stock.txt", False, 640, t + 5 * hour), (4, 2, "soup.jpeg", False, 90_000, t + hour), (5, 2, "bread.txt", False, 12, t + 9 * hour),
        (6, 2, "soups", True, None, None), (7, 6, "leek.txt", False, 55, t + 2 * hour), (8, None, "N:", True, None, None), (9, 8, "spare soup.csv", False, 3, t + 7 * hour), (10, 8, "pantry", True, None, None), (11, 10, "jam.csv", False, 700, t),
    ]
    return derived(with_paths(spark.createDataFrame([(*r, r[5]) for r in rows], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))


def test_sample_tree(spark):
    entries = sample(spark)
    names = lambda df: [r.name for r in df.collect()]
    assert names(api.search_files(entries, "soup ext:txt,csv", sort="name_folded")) == ["leek.txt", "soup stock.txt".capitalize(), "spare soup.csv"]
    assert api.count_files(entries, "soup").first().asDict() == {"items": 4, "files": 3, "folders": 1}
    assert names(api.list_folder(entries, 2)) == ["soups", "bread.txt", "Soup stock.txt", "soup.jpeg"]
    assert names(api.recent_files(entries, 2)) == ["bread.txt", "spare soup.csv"]
    assert names(api.search_files(entries, "ext:txt;csv", sort="size", descending=True, hidden_folders=[6, 10])) == ["Soup stock.txt", "bread.txt", "spare soup.csv"]
    assert names(api.search_files(entries, "^soup", sort="modified", offset=1, limit=1)) == ["Soup stock.txt"]
    assert names(api.get_file_info(entries, "n:\\PANTRY\\Jam.csv")) == ["jam.csv"]
    assert names(api.search_files(entries, "soups leek")) == ["leek.txt"]
    assert names(api.search_files(entries, "ext:txt;csv", preferred=["csv"], limit=1)) == ["spare soup.csv"]
    assert [(r.name, r.score) for r in api.search_files(entries, "soup.jpeg | bread.txt", low_priority=["kitchen"]).collect()] == [("bread.txt", 78), ("soup.jpeg", 78)]  # 30 + 60 + 25 - 35 - 2


def test_filters_reach_the_scan(spark, tmp_path):
    sample(spark).write.parquet(str(tmp_path / "e"))
    written = spark.read.parquet(str(tmp_path / "e"))
    found = api.Q.search(written, "ext:txt size:>50 dm:2020-09..2021")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line).split("PushedFilters:")[1]
    assert all(x in pushed for x in ("GreaterThanOrEqual(size,51)", "LessThan(modified,", "EqualTo(ext,txt)")) and sorted(r.name for r in found.collect()) == ["Soup stock.txt", "leek.txt"]


def test_a_tree_of_any_depth_and_a_circle(spark):
    deep = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(12)], "id long, parent_id long, name string")
    assert with_paths(deep).groupBy().max("id").first()[0] == 11
    with pytest.raises(ValueError):
        with_paths(spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (1, 2, "c")], "id long, parent_id long, name string"))


def test_scores(spark):
    entries = entry(spark, ["report.txt", "my report.txt", "myreport.txt", "MyReport.txt", "report"])
    ways = Q.parse("report")
    got = {r.name: r.s for r in entries.where("NOT is_dir").select("name", rank.score(ways).alias("s")).collect()}
    assert got["report"] == 30 + 60 + 25 and got["report.txt"] == 30 + 45 + 15
    assert got["my report.txt"] == 18 + 11 == got["MyReport.txt"] - 1 and got["myreport.txt"] == 4 + 12


def test_unknown_values_are_last(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, size long")
    assert [r.id for r in rank.by(rows, "size").collect()] == [1, 3, 2] and [r.id for r in rank.by(rows, "size", True).collect()] == [3, 1, 2]
