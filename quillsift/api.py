"""The tools' names and parameters as functions over an entries or documents DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.operators import arrange, content, hierarchy
from quillsift.plans import query as Q
from quillsift.plans import rank


def visible(rows: DataFrame, hidden_folders: list[int]) -> DataFrame:
    """What a caller may see; applied before anything is counted."""
    return rows.where(~hierarchy.within(hidden_folders)) if hidden_folders else rows


def search_files(entries: DataFrame, query: str, limit: int = 30, offset: int = 0, sort: str = "match", descending: bool = False, regex: bool = False, now: dt.datetime | None = None, hidden_folders: list[int] = (), readings: DataFrame | None = None, preferred: list[str] = (), low_priority: list[str] = ()) -> DataFrame:
    """Ranked rows of a search text; `limit` is at most 200. Extensions in `preferred` gain points, folders named in
    `low_priority` and those with a dot in front lose them with all that is in them. With readings (char, reading,
    place) Han names are found by their sound."""
    ways = Q.parse(query, regex, now)
    rows = Q.heard(visible(entries, list(hidden_folders)), ways, readings)
    f = Q.fields(sounds="sounds" in rows.columns)
    low = arrange.low_priority(low_priority)
    hits = rows.where(Q.predicate(ways, f)).withColumn("score", rank.entry_score(rank.score(ways, f), low, F.lit(False), list(preferred), Q.exact_name(ways, f)))
    if f.sounds is not None:
        hits = hits.drop("sounds")
    ordered = rank.by_match(hits) if sort == "match" else rank.by(hits, sort, descending)
    return ordered.offset(offset).limit(min(limit, 200))


def count_files(entries: DataFrame, query: str, **options) -> DataFrame:
    """Totals of all that a text finds: items, files, folders."""
    hits = visible(entries, list(options.pop("hidden_folders", ()))).where(Q.predicate(Q.parse(query, **options), Q.fields()))
    return hits.agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"))


def recent_files(entries: DataFrame, limit: int = 30, hidden_folders: list[int] = ()) -> DataFrame:
    return rank.by(visible(entries, list(hidden_folders)).where("NOT is_dir"), "modified", descending=True).limit(limit)


def list_folder(entries: DataFrame, folder: int, limit: int = 200, hidden_folders: list[int] = ()) -> DataFrame:
    """Folders first, then by name."""
    return visible(entries, list(hidden_folders)).where(hierarchy.child_of(folder)).orderBy(F.desc("is_dir"), "name_folded", "id").limit(limit)


def get_file_info(entries: DataFrame, path: str, hidden_folders: list[int] = ()) -> DataFrame:
    from quillsift.functions.text import fold, folded

    return visible(entries, list(hidden_folders)).where(folded(F.col("path")) == fold(path))


def search_content(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", limit: int = 20, index: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """Documents whose text matches, the best first: by the line that has most of the words. Each text is read once;
    `index` holds postings of the distinct texts, `hidden` (key) the documents that a caller may not see."""
    seen = docs if hidden is None else docs.join(hidden.select(key), key, "left_anti")
    distinct, which = content.contents(seen, key, text)
    found = content.search(distinct, index, query)
    words = [w for way in content.pattern(query) for w in way if not w.startswith(("regex:", "re:"))]
    if not words:
        return which.join(found.select("content_id"), "content_id").orderBy(key).limit(min(limit, 100))
    best = content.best_lines(content.lines(found, "content_id", "text"), words).select(F.col("doc").alias("content_id"), "hits", "starts", F.col("text").alias("line"))
    scored = found.select("content_id").join(best, "content_id", "left").fillna(0, ["hits", "starts"])
    points = content.relevance(scored, len(words), F.lit(0), F.lit(0), F.lit(1000))
    ranked = scored.withColumn("text", F.coalesce("line", F.lit(""))).withColumn("score", F.when(F.col("hits") > 0, points).otherwise(0)).select("content_id", "score")
    return which.join(ranked, "content_id").orderBy(F.desc("score"), key).limit(min(limit, 100))
