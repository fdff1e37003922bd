"""Texts of another tool: what each of its functions means, and that what can't be said finds nothing."""

import pytest

from quillsift.plans import foreign as X
from quillsift.sources.entries import derived, with_paths

PLACES = [
    (r'"P:\Land Maps\" contour', ("contour",), (r"P:\Land Maps",), ()),
    (r"P:\maps\ q:", ("q:",), (r"P:\maps",), ()),
    (r'"\\atlas\sheets\"', (), (r"\\atlas\sheets",), ()),
    (r"P:\maps\nor", (), (), (r"P:\maps\nor",)),
    (r"P:\maps\nor P:\MAPS\NOR", (), (), (r"P:\maps\nor",)),
    (r"\\atlas\sheets\1950 grid", ("grid",), (), (r"\\atlas\sheets\1950",)),
    (r"P:\maps\*.tif", ("*.tif",), (r"P:\maps",), ()),
    (r'"P:\old maps\sheet 1?.tif"', ('"sheet 1?.tif"',), (r"P:\old maps",), ()),
    (r"P:\ma?s\a.tif", (r"P:\ma?s\a.tif",), (), ()),
    (r'<"P:\maps\"> hill', ("hill",), (r"P:\maps",), ()),
    (r'hill <"P:\maps\"|"R:\">', ("hill",), (r"P:\maps", "R:"), ()),
    (r'!"P:\maps\" hill', (r'!"P:\maps\"', "hill"), (), ()),
    ("size:<3kb <", ("size:<3kb",), (), ()),
]


@pytest.mark.parametrize("text,words,folders,starts", PLACES[:-1])
def test_places(text, words, folders, starts):
    m = X.translate(text)
    assert (m.words, m.folders, m.starts, m.refused) == (words, folders, starts, "")


@pytest.mark.parametrize("name", sorted(X.COMPARING))
def test_modifiers_leave_the_word(name):
    assert X.translate(f"{name.upper()}:ridge").words == ("ridge",) and X.translate(f"!{name}:ridge").words == ("!ridge",)


@pytest.mark.parametrize("name", sorted(X.UNKNOWN))
def test_unknown_functions_are_refused(name):
    m = X.translate(f"ridge {name}:7")
    assert m.refused == f"{name}:" and m.words == ("ridge",)


def test_kinds_and_functions():
    t = X.translate
    assert [t(x).kind for x in ("file:a", "files: a", "folder:a", "nopath:folders:a", "attrib:D a", "!attrib:d a", "attributes:!D a", "a")] == ["files", "files", "folders", "folders", "folders", "files", "files", "any"]
    assert t(r'parent:"P:\maps" a').direct_in == r"P:\maps" == t("infolder:P:\\maps\\").direct_in and t(r"!parent:P:\maps").refused == "!parent:"
    assert t("a count:12").count == 12 and t("a count:x").count is None and t("a count:12").words == ("a",)
    assert t("ext:TIF;png").query == "ext:TIF,png" and t('ext:"tif;png"').query == "ext:tif,png" and t("datemodified:>2020").query == "dm:>2020"
    assert t("size:>1mb regex:^a odd:word").query == "size:>1mb regex:^a odd:word"
    assert t("hill|dale top").query == "hill | dale top" and t('"hill|dale"').query == '"hill|dale"' and t("").query == ""
    assert t("root:").roots and not t("root:").refused and t("?:").roots and t("root: a").refused == t("!root:").refused == t("*: a").refused == t("root:a").refused == "root:"
    assert t("<hill dale> | a").refused == t('<"P:\\a\\" b').refused == t("<P:\\a>").refused == "<>" and not t("size:<3kb").refused
    assert t(r" ^a\d|b ", regex=True).words == (r"^a\d|b",) and t(" ", regex=True).regex is False


def test_search(spark):
    nodes = [(1, None, "P:", True), (2, 1, "maps", True), (3, 2, "north", True), (4, 3, "hill.tif", False), (5, 2, "hill.txt", False), (6, 1, "hill top.tif", False), (7, None, "R:", True), (8, 7, "hill", True), (9, 2, "nor", False)]
    entries = derived(with_paths(spark.createDataFrame([(*r, 1, 1, 1) for r in nodes], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long"))).cache()
    found = lambda text, **o: sorted(r.id for r in X.search(entries, text, **o).collect())
    assert found(r'"P:\MAPS\" hill') == [4, 5] and found(r"parent:P:\maps hill") == [5] and found(r"P:\maps\nor") == [3, 4, 9]
    assert found("file:hill") == [4, 5, 6] and found("folder:hill") == [8] and found("root:") == [1, 7] and found("hill count:2") == [4, 5]
    assert found(r"P:\*.tif") == [4, 6] and found(r'<"P:\maps\" | "R:\"> hill') == [4, 5, 8] and found(r"^hill\.t", regex=True) == [4, 5]
    assert found("hill attrib:H") == found("<hill> dale") == found("root: hill") == found("a |") == found("re:(") == []
    assert found("hill|north !top") == [3, 4, 5, 6, 8]
