"""Refinement, projections, exports; the module's queries against their SQL twins."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import quillsift.details as details
from quillsift import queries
from quillsift.functions import text as T
from quillsift.operators import content, refine
from quillsift.plans import query as Q
from quillsift.sources import export

OWN = [n for n, f in queries.QUERIES.items() if f.__module__ == details.__name__] + ["gram_fingerprints"]


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    yield db
    db.close()


@pytest.mark.parametrize("name", OWN)
def test_twins(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr) == sorted(rows, key=repr) and rows


@pytest.mark.parametrize(
    "text, parts",
    [
        (r"C:\My Files\tax 2020", ["c:", "my files", "tax 2020"]), ("d:", ["d:", ""]), ("e:/a b/", ["e:", "a b", ""]), (r'"C:\x y\z"', ["c:", "x y", "z"]),
        (r"\\nas\some share\a", ["", "", "nas", "some share", "a"]), (r"C:\*.pdf", None), ("report", None), (r"a\b", None), ("c: x", None), ("", None), (r"C:\Old$", ["c:", "old$"]),
    ],
)
def test_typed_paths(text, parts):
    assert Q.typed_path(text) == parts


def test_a_path_is_one_term(spark):
    rows = [("my soup.txt", ["m:", "the kitchen"]), ("soup.txt", ["n:", "the kitchen"]), ("my.txt", ["m:", "the kitchen"])]
    df = spark.createDataFrame([(n, n, f, "txt", False, 1, 1) for n, f in rows], "name string, name_folded string, folders array<string>, ext string, is_dir boolean, size long, modified long")
    assert [r.name for r in Q.search(df, r"M:\The Kitchen\my soup").collect()] == ["my soup.txt"]
    assert [r.name for r in Q.search(df, "m:").collect()] == ["my soup.txt", "my.txt"]


def test_refined(spark):
    df = spark.createDataFrame([("The cat",), ("the cats",), ("écat",), ("cat_1",), ("Cat.",), (None,)], "t string")
    hits = lambda *a, **k: [r.t for r in df.where(refine.refined(F.col("t"), *a, **k)).collect()]
    assert hits("cat", whole_word=True) == ["The cat", "Cat."] and hits("cat", case=True, whole_word=True) == ["The cat"]
    assert hits("Cat", case=True) == ["Cat."] and hits("CAT") == ["The cat", "the cats", "écat", "cat_1", "Cat."]
    assert hits("ÉC") == ["écat"] and hits("c.t$", regex=True) == ["The cat", "écat"] and hits("cat.", whole_word=True) == ["Cat."] and len(hits("")) == 6


def test_utf16_places(spark):
    df = spark.createDataFrame([("a\U0001f600b报",)], "t string")
    got = df.select(*[refine.utf16(F.col("t"), F.lit(i)).alias(f"p{i}") for i in range(5)]).first()
    assert list(got) == [0, 1, 3, 4, 5]


def test_ranked(spark):
    df = spark.createDataFrame([(1, 5, 100), (2, 9, None), (3, 1, 300), (4, 7, 10**9), (5, 8, 100)], "id long, relevance int, modified long")
    order = lambda by: [r.id for r in refine.ranked(df, "id", 400, by).collect()]
    assert order("match") == [2, 5, 4, 1, 3] and order("newest") == [3, 5, 1, 2, 4] and order("oldest") == [5, 1, 3, 2, 4]


def test_copies_and_written_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "warm bread"), (2, "warm bread"), (3, "cold soup"), (4, None)], "doc_id long, text string")
    distinct, which = content.contents(docs, "doc_id", "text")
    path = str(tmp_path / "postings")
    content.write_postings(content.postings(distinct), path)
    index = spark.read.parquet(path)
    found = content.search(distinct, index, "bread")
    assert sorted(r.doc_id for r in refine.documents_of(found, which).collect()) == [1, 2]
    plan = index.where(F.col("gram").isin("war", "rea"))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([(1, '=1+1, "x"', r"C:\a b"), (2, " é ", r"C:\ä")], "id long, name string, path string").coalesce(1)
    export.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfid,name,path\r\n") and '1,"\'=1+1, ""x""",C:\\a b\r\n'.encode() in text and "2, é ,C:\\ä\r\n".encode() in text
    export.write_paths(df, str(tmp_path / "nul"), nul=True)
    assert next((tmp_path / "nul").glob("part-*")).read_bytes() == "C:\\a b\0C:\\ä\0".encode()
    export.snapshot(df, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).exceptAll(df).isEmpty()
    with pytest.raises(Exception, match="already exists"):
        export.snapshot(df, str(tmp_path / "snap"))


def test_halves_go_to_the_even_figure(spark):
    """As printf rounds them: 180.5, 181.5, 10.25, 10.75 and 1.125 KB."""
    sizes = (184832, 185856, 10496, 11008, 1152)
    row = spark.range(1).select(*[T.size_text(F.lit(n)).alias(f"s{i}") for i, n in enumerate(sizes)]).first()
    assert list(row) == ["180 KB", "182 KB", "10.2 KB", "10.8 KB", "1.12 KB"]
