"""The order that results are shown in: the typed folder's own, recent items, exact names, kinds apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import fold, stem
from quillsift.sources.stored import kept

#: Recently opened items that go in front of the others.
RECENT = 3


def best() -> list[Column]:
    return [F.desc("score"), F.desc("modified"), F.asc("id")]


def inside_first(hits: DataFrame, inside: Column, order: list[Column], limit: int) -> DataFrame:
    """Hits inside the typed folder first, then the others, each part in order."""
    return hits.withColumn("inside", F.coalesce(inside, F.lit(False))).orderBy(F.desc("inside"), *order).limit(limit)


def by_folder(df: DataFrame) -> DataFrame:
    """Folder by folder as a walk of the tree meets them: folded parts are compared, not the path's characters."""
    return df.orderBy("folders", "name_folded", "id")


def exact_name(typed: list[str]) -> Column:
    """Named just what was typed; of files the name without its extension counts too."""
    names = [fold(t) for t in typed]
    return F.col("name_folded").isin(names) | (~F.col("is_dir") & stem(F.col("name_folded")).isin(names))


def with_history(hits: DataFrame, history: DataFrame) -> DataFrame:
    """Left join to a history (id, opened): when each hit was opened last."""
    return hits.join(history.groupBy("id").agg(F.max("opened").alias("opened")), "id", "left")


def with_favourites(hits: DataFrame, favourites: DataFrame) -> DataFrame:
    """Left join to favourites (id): whether each hit is one."""
    return hits.join(favourites.select("id").distinct().withColumn("favourite", F.lit(True)), "id", "left").withColumn("favourite", F.coalesce("favourite", F.lit(False)))


def arranged(hits: DataFrame, history: DataFrame, typed: list[str], preferred: list[str], limit: int, folders_first: bool = False) -> DataFrame:
    """Hits (with score) as they are listed: the RECENT ones opened last, then those named just what was typed, files
    of preferred types in front of them, then the two kinds apart. Adds part (0 to 4).

    The recent ones are RECENT rows at most, so they are broadcast."""
    opened = history.join(hits.select("id"), "id").groupBy("id").agg(F.max("opened").alias("opened"))
    recent = opened.orderBy(F.desc("opened"), "id").limit(RECENT)
    exact = exact_name(typed)
    part = F.when(F.col("opened").isNotNull(), 0).when(exact & ~F.col("is_dir") & F.col("ext").isin(preferred), 1).when(exact, 2)
    part = part.when(F.col("is_dir") == folders_first, 3).otherwise(4)
    return hits.join(F.broadcast(recent), "id", "left").withColumn("part", part).orderBy("part", F.desc_nulls_last("opened"), *best()).limit(limit)


def tree_folder() -> Column:
    """The folder that stands for a file's tree: of a user's folder the fourth level below the root, elsewhere the first,
    or the file's own folder where the tree is not that deep. A file in no folder has none."""
    above = F.size("ancestor_ids")
    profile = (above >= 3) & (F.get("folders", F.lit(1)) == "users")
    return F.get("ancestor_ids", F.least(F.when(profile, 4).otherwise(1), above - 1))


def low_priority(rules: list[str] = ()) -> Column:
    """In a folder, or itself a folder, with a dot in front of its name or named by a rule (folded)."""
    low = lambda x: x.startswith(".") | x.isin(list(rules))
    return F.exists("folders", low) | (F.col("is_dir") & low(F.col("name_folded")))


def matching_names(rows: DataFrame, name: str, predicate: Column, names: DataFrame | None = None) -> DataFrame:
    """Rows whose name fits a costly predicate, which is tested once for each name, not for each row.

    The different names are a table of their own (`names`, written here where none is kept), and so are those that fit:
    a plan that still knew the predicate would test it on every row again."""
    known = kept(rows.select(name).distinct(), "names") if names is None else names
    return rows.join(kept(known.where(predicate), "fitting"), name, "left_semi")


def to_read(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose contents are not known (id, stamp) or have changed since: id and why (new, changed)."""
    both = entries.where("NOT is_dir").select("id", "modified").join(known.select("id", "stamp", F.lit(True).alias("_known")), "id", "left")
    why = F.when(F.col("_known").isNull(), "new").when(~F.col("stamp").eqNullSafe(F.col("modified")), "changed")
    return both.select("id", why.alias("why")).where("why IS NOT NULL")
