"""Alignment of terms with what Han names sound like, against trying all ways one by one."""

import random

import pytest
from pyspark.sql import functions as F

from quillsift import api
from quillsift.plans import pinyin
from quillsift.plans import query as Q
from quillsift.plans import rank
from quillsift.sources.entries import derived, with_paths

READINGS = {"水": ["shui"], "果": ["guo", "luo"], "绿": ["lv", "lu"], "山": ["shan"], "重": ["zhong", "chong", "tong", "zzz"], "啊": ["a"], "欧": ["ou"]}


def readings(spark):
    return spark.createDataFrame([(c, r, i + 1) for c, rs in READINGS.items() for i, r in enumerate(rs)], "char string, reading string, place int")


def ends(name, at, term, done, most):
    """All places where a term that begins at a place may end."""
    if done == len(term):
        return {at}
    if at == len(name):
        return set()
    c, out = name[at], set()
    if c.isascii():
        return ends(name, at + 1, term, done + 1, most) if c.lower() == term[done] else set()
    for sound in READINGS.get(c, [])[:most]:
        n = 0
        while n < len(sound) and done + n < len(term) and (sound[n] == term[done + n] or sound[n] == "v" and term[done + n] == "u"):
            n += 1
            out |= ends(name, at + 1, term, done + n, most)
    return out


def first(name, term, most):
    for at in range(len(name)):
        if found := ends(name, at, term, 0, most):
            return at, min(found) - at
    return None


@pytest.mark.parametrize("term", ["shg", "shuiguo", "sl", "lushan", "lvs", "zh", "cs", "to", "zz", "aa", "aou", "uo", "u1", "v1", "s1s", "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijk", "a" * 63])
def test_first_and_shortest_place(spark, term):
    rng = random.Random(8)
    names = list(dict.fromkeys(["水果", "a", "", "漢", "啊" * 70, "水" * 40, "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijk水"] + ["".join(rng.choice("水果绿山重啊欧漢sguv1S- ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]))
    rows = pinyin.with_sounds(spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(-1, None)], "id long, name string"), readings(spark))
    got = {r.id: r for r in rows.select("id", pinyin.span(F.col("sounds"), term).alias("all"), pinyin.span(F.col("sounds"), term, 1).alias("one")).collect()}
    assert len(got) == len(names) + 1 and got[-1].all is None
    for i, n in enumerate(names):
        han = any("一" <= c <= "鿿" for c in n)
        for found, most in ((got[i].all, 3), (got[i].one, 1)):
            assert (tuple(found) if found else None) == (first(n, term, most) if han else None), (n, term, most)


def test_what_is_a_term():
    assert [pinyin.is_term(t) for t in ("bg", "b2", "b", "22", "b-g", "é1", "a" * 63, "a" * 64)] == [True, True, False, False, False, False, True, False]


def test_search_by_sound(spark):
    nodes = [(1, None, "D:", True), (2, 1, "画", True)] + [(10 + i, 2, n, False) for i, n in enumerate(["水果.txt", "water.txt", "山水果.md", "啊.txt", "shuiguo.txt"])]
    entries = derived(with_paths(spark.createDataFrame([(*r, 1, 1, 1) for r in nodes], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))
    found = api.search_files(entries, "shuig", readings=readings(spark))
    assert [r.name for r in found.collect()] == ["水果.txt", "shuiguo.txt", "山水果.md"]
    assert "sounds" not in found.columns
    assert [r.name for r in api.search_files(entries, "!shuig txt", readings=readings(spark), sort="name_folded").collect()] == ["water.txt", "啊.txt", "水果.txt"]
    assert Q.search(entries, "sg").count() == 0 and Q.search(entries, '"sg"', readings=readings(spark)).count() == 0


def test_words_as_they_sound():
    known = {"重": ["zhong", "chong", "tong"], "行": ["xing", "hang", "heng"], "山": ["shan"]}
    assert pinyin.spoken("重山", known) == ["zhongshan", "chongshan", "tongshan"] and pinyin.spoken("a1", known) == []
    assert pinyin.spoken("x行重", known) == ["x" + a + b for a in known["行"] for b in known["重"]][:8] and len(pinyin.spoken("重行重行", known)) == 8


def test_sounds_are_only_read_where_nothing_is_found(spark, monkeypatch):
    nodes = [(1, None, "D:", True)] + [(10 + i, 1, n, False) for i, n in enumerate(["水果.txt", "山.txt", "shuiluo.md"])]
    entries = derived(with_paths(spark.createDataFrame([(*r, 1, 1, 1) for r in nodes], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))
    rows = spark.createDataFrame([*((c, r, i + 1) for c, rs in READINGS.items() for i, r in enumerate(rs)), ("睡", "shui", 1), ("过", "guo", 1), ("过", "luo", 2)], "char string, reading string, place int")
    got = rank.scored(entries, "睡过", rows).collect()
    assert sorted((r.name, r.approximate, r.score) for r in got) == [("shuiluo.md", True, 30 + 45 + 17), ("水果.txt", True, 26 + 40 + 15)]
    assert rank.scored(entries, "睡过 | 山", rows).count() == 1 and rank.scored(entries, "re:睡", rows).count() == 0 and rank.scored(entries, "!山 睡x", rows).count() == 0
    monkeypatch.setattr(Q, "homophones", lambda *a: pytest.fail("the second stage was made"))
    assert [(r.name, r.approximate) for r in rank.scored(entries, "水果", rows).collect()] == [("水果.txt", False)]


def test_pages_say_whether_there_is_more(spark):
    rows = spark.range(1, 8)
    told = lambda after, size: [(r.id, r.next_cursor, r.truncated) for r in rank.answer(rows, after, size).collect()]
    assert told(None, 3) == [(1, 3, True), (2, 3, True), (3, 3, True)] and told(3, 4) == [(i, None, False) for i in (4, 5, 6, 7)] and told(7, 2) == []


def test_names_are_heard_once(spark):
    """Copies of a name share its alignment: nothing above the join with the different names aligns again."""
    nodes = [(1, None, "D:", True)] + [(10 + i, 1, ["水果.txt", "shui.txt", "山水果.md"][i % 3], False) for i in range(30)]
    entries = derived(with_paths(spark.createDataFrame([(*r, 1, 1, 1) for r in nodes], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long")))
    hits = Q.search(entries, "shuig", readings=readings(spark)).withColumn("score", rank.score(Q.parse("shuig"), Q.fields(sounds=True)))
    assert sorted((r.name, r.score) for r in hits.collect()) == [("山水果.md", 4 + 12)] * 10 + [("水果.txt", 26 + 40 + 15)] * 10
    above = hits._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "sounds" in above and "lambda" not in above
