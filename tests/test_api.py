"""The tools: none shows what a caller may not see, and searches rank."""

import pytest
from pyspark.sql import functions as F

from quillsift import api
from quillsift.operators import arrange
from quillsift.sources.entries import derived, with_paths
from quillsift.sources.stored import Folder, once

TREE = [(1, None, "S:", True), (2, 1, "open", True), (3, 2, "plan.txt", False), (4, 1, "secret", True), (5, 4, "plan.txt", False), (6, 4, "deep", True), (7, 6, "plan b.md", False), (8, 1, "plan.txt", False)]


@pytest.fixture(scope="module")
def entries(spark):
    return derived(with_paths(spark.createDataFrame([(*r, 1, 1_600_000_000 + r[0], 1) for r in TREE], "id long, parent_id long, name string, is_dir boolean, size long, modified long, created long"))).cache()


TOOLS = {
    "search": lambda e, h: api.search_files(e, "plan", hidden_folders=h),
    "recent": lambda e, h: api.recent_files(e, hidden_folders=h),
    "folder": lambda e, h: api.list_folder(e, 4, hidden_folders=h),
    "root": lambda e, h: api.list_folder(e, 1, hidden_folders=h),
    "info": lambda e, h: api.get_file_info(e, "s:\\secret\\deep\\plan b.md", hidden_folders=h),
}


@pytest.mark.parametrize("tool", TOOLS)
def test_hidden_folders_are_in_no_answer(entries, tool):
    seen, all_ = ({r.id for r in TOOLS[tool](entries, h).collect()} for h in ([4], []))
    assert seen == all_ - {4, 5, 6, 7} and all_ & {4, 5, 6, 7}
    assert api.count_files(entries, "plan", hidden_folders=[4]).first().items == 2


def test_content_ranks_and_leaves_out(spark):
    docs = spark.createDataFrame([(1, "the grey owl\nhoots"), (2, "owl\nfar from\ngrey"), (3, "a grey owl"), (4, "no bird"), (5, "greyish owls")], "doc_id long, text string")
    got = api.search_content(docs, "grey owl").collect()
    assert [r.doc_id for r in got] == [1, 3, 5, 2] and got[0].score > got[-1].score
    hidden = spark.createDataFrame([(3,)], "doc_id long")
    assert [r.doc_id for r in api.search_content(docs, "grey owl", hidden=hidden, limit=2).collect()] == [1, 5]
    assert [r.doc_id for r in api.search_content(docs, "re:^owl$").collect()] == [2]


def test_costly_predicates_meet_each_name_once(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("name"))
    found = arrange.matching_names(rows, "name", F.col("name").rlike("n[35]"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and found.count() == sum(i % 7 in (3, 5) for i in range(1000))


def test_a_session_builds_once_until_a_source_changes(spark, tmp_path):
    source, built = str(tmp_path / "t"), []
    spark.range(3).write.parquet(source)
    build = lambda path: (built.append(path), spark.read.parquet(source).write.parquet(path))
    first = once(spark, "t", [source], build)
    assert once(spark, "t", [source], build) == first and len(built) == 1
    import os

    os.utime(source, (1, 1))
    assert Folder(spark, source).changed() == 1000 and once(spark, "t", [source], build) != first and len(built) == 2
