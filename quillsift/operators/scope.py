"""Folders as a search text or a rule names them: where to look, what to hide, where a path leads.

Everything is resolved on the folders alone, a small part of the entries, and reaches the rest through the ids of the
folders above an entry; no file is exploded over its folders.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import fold, folded
from quillsift.operators.hierarchy import glob_regex
from quillsift.operators.relate import decayed

#: Folders that names may stand for approximately.
APPROXIMATE = 200
#: Places that a typed path leads to.
LEADS = 3
_SEPARATORS = "\\/\uff0f"


@dataclass(frozen=True)
class Place:
    """A folder as it was typed: a full path, or names from some folder along the way."""

    typed: str
    path: str = ""
    names: tuple[str, ...] = ()


def _names(word: str) -> tuple[str, ...]:
    names = tuple(fold(n) for n in re.split(f"[{re.escape(_SEPARATORS)}]", word.strip(_SEPARATORS)))
    return names if all(names) else ()


def split_scope(text: str) -> tuple[str, list[Place]]:
    """The words of a content search, and the folders that it names: a full path, quoted or up to a blank; a word with a
    separator behind it (`work/abc/`); as the last word also one with a separator in front (`/abc`), if words are left."""
    tokens = [(m[0], m[0].startswith(('"', '!"'))) for m in re.finditer(r'!?"[^"]*"?|\S+', text)]
    places: dict[int, Place] = {}
    for i, (word, quoted) in enumerate(tokens):
        bare = word.strip('"')
        if re.match(rf"[A-Za-z]:[{re.escape(_SEPARATORS)}]|\\\\[^\\]+\\[^\\]", bare) and not re.search(r"[*?]", bare):
            places[i] = Place(word, path=fold(re.sub(f"[{re.escape(_SEPARATORS)}]", r"\\", bare)).rstrip("\\"))
        elif not quoted and word[0] != "!" and not re.search(r"[*?:]", word) and len(word) > 1:
            if word[-1] in _SEPARATORS and (names := _names(word)):
                places[i] = Place(word, names=names)
            elif i == len(tokens) - 1 and word[0] in "/\uff0f" and len(names := _names(word)) == 1 and any(j not in places for j in range(i)):
                places[i] = Place(word, names=names)
    return " ".join(w for i, (w, _) in enumerate(tokens) if i not in places), list(places.values())


def led_to(folders: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Folders named just so whose folders directly above are named so too."""
    hit = F.col("name_folded") == names[-1]
    for i, name in enumerate(reversed(names[:-1])):
        hit = hit & (F.get("folders", F.size("folders") - 1 - i) == name)
    return folders.where(hit)


def like(folders: DataFrame, names: tuple[str, ...], most: int = APPROXIMATE) -> DataFrame:
    """Folders whose names hold the last name, in folders whose names hold the others, in that order with gaps: the `most`
    shallowest."""
    from quillsift.plans.query import in_folders

    hit = F.contains("name_folded", F.lit(names[-1]))
    if len(names) > 1:
        hit = hit & in_folders([*reversed(names[:-1])], F.col("folders"))
    return folders.where(hit).orderBy("depth", "id").limit(most)


@dataclass
class Scope:
    """Where a content search looks: ids of folders (APPROXIMATE a place at most, or all that are named just so), what is
    left as words, and how each place was read: path, exact, approximate, words or missing."""

    words: str
    readings: dict[str, str]
    folders: DataFrame | None


def resolve(entries: DataFrame, text: str, aside: Column | None = None) -> Scope:
    """Reads the places of a text on the folders. Names that no folder has are read approximately, and are words where that
    finds none either; a path that is no folder finds nothing. Folders `aside` (of low priority) only count where a
    place has no others."""
    words, places = split_scope(text)
    folders = entries.where("is_dir").withColumn("aside", F.coalesce(aside, F.lit(False)) if aside is not None else F.lit(False)).select("id", "name_folded", "folders", "depth", "path", "aside")
    readings, found = {}, None
    for place in places:
        if place.path:
            one, how = folders.where(folded(F.col("path")) == place.path), "path"
            if one.isEmpty():
                how = "missing"
        else:
            one, how = led_to(folders, place.names), "exact"
            if one.isEmpty():
                one, how = like(folders, place.names), "approximate"
                if one.isEmpty():
                    readings[place.typed], words = "words", f"{words} {place.typed}".strip()
                    continue
            if not one.where("NOT aside").isEmpty():
                one = one.where("NOT aside")
        readings[place.typed] = how
        found = one.select("id") if found is None else found.unionByName(one.select("id"))
    return Scope(words, readings, None if found is None else found.distinct())


def inside(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries in one of the folders (id) at any depth: each meets them by the folders above it, and files of one folder
    meet them once, as that folder."""
    up = entries.where("is_dir").select(F.col("id").alias("_f"), F.explode(F.concat("ancestor_ids", F.array("id"))).alias("id"))
    below = up.join(folders, "id", "left_semi").select("_f").distinct()
    return entries.join(below, F.col("parent_id") == F.col("_f"), "left_semi")


# ---- folders that rules hide


def ruled(rules: list[str]) -> Column:
    """Whether a folder (name_folded, folders, path) is named by a rule: a name or a tail of names (`cache\tmp`) at any
    depth, or a full path that begins with a drive or a share; * and ? stand for any run and any one character."""
    one = lambda column, part: column.rlike(glob_regex(part)) if re.search(r"[*?]", part) else column == part
    hits = []
    for rule in map(fold, rules):
        if re.match(r"[a-z]:|\\\\", rule):
            hits.append(one(folded(F.col("path")), rule.rstrip("\\")))
            continue
        *above, last = re.split(r"[\\/]", rule.strip("\\/"))
        hit = one(F.col("name_folded"), last)
        for i, part in enumerate(reversed(above)):
            hit = hit & F.coalesce(one(F.get("folders", F.size("folders") - 1 - i), part), F.lit(False))
        hits.append(hit)
    return reduce(Column.__or__, hits, F.lit(False))


def hidden_folders(entries: DataFrame, rules: list[str]) -> DataFrame:
    """Ids of the folders that rules hide, and of all folders in them: rules are tested on folders alone, once each, and
    passed down by the ids above a folder."""
    folders = entries.where("is_dir").select("id", "name_folded", "folders", "path", "ancestor_ids")
    own = folders.where(ruled(rules)).select(F.col("id").alias("_top"))
    up = folders.select("id", F.explode(F.concat("ancestor_ids", F.array("id"))).alias("_top"))
    return up.join(own, "_top", "left_semi").select("id").distinct()


def shown(entries: DataFrame, rules: list[str], file_rule: Column | None = None) -> DataFrame:
    """entries with `reason`: shown, folder (in a hidden folder or one itself) or file (by its own rule). What both skip is
    in no set, as it is not shown without either, and is left out. A file meets the hidden folders by its parent."""
    gone = hidden_folders(entries, rules).withColumn("_hidden", F.lit(True))
    at = F.when(F.col("is_dir"), F.col("id")).otherwise(F.col("parent_id"))
    rows = entries.withColumn("_at", at).join(gone.withColumnRenamed("id", "_at"), "_at", "left").drop("_at")
    hidden, file = F.coalesce("_hidden", F.lit(False)), F.coalesce(file_rule, F.lit(False)) if file_rule is not None else F.lit(False)
    reason = F.when(hidden & file, "both").when(hidden, "folder").when(file, "file").otherwise("shown")
    return rows.withColumn("reason", reason).drop("_hidden").where("reason <> 'both'")


# ---- where a typed path leads, and what was chosen before


def path_leads(entries: DataFrame, typed: str, history: DataFrame, aside: Column, now: int, folders_only: bool = False) -> DataFrame:
    """The LEADS entries that a path typed from some folder along the way leads to: those opened last (history: id, opened)
    first, then those that are not aside, the shallowest, the newest; times more than a day ahead count as unknown."""
    rows = led_to(entries.where("is_dir") if folders_only or typed[-1:] in ("\\", "/") else entries, _names(typed))
    opened = history.groupBy("id").agg(F.max("opened").alias("opened"))
    known = F.when((F.col("modified") > 0) & (F.col("modified") <= now + 86_400), F.col("modified"))
    order = [F.desc_nulls_last("opened"), aside.asc(), F.asc("depth"), known.desc_nulls_last(), F.asc("id")]
    return rows.join(opened, "id", "left").orderBy(*order).limit(LEADS)


def learned_first(hits: DataFrame, visits: DataFrame, typed: str, now: Column, limit: int) -> DataFrame:
    """Hits in their order, what was chosen before in front: adds `learned`, and a learned hit's score is 300 and its bonus
    at least. visits are (id, text, ts), text null where nothing was typed.

    An entity weighs 1 for each visit, halved every 14 days, and so does each text that led to it. The best text decides:
    group 0 the same one, 1 a text with it inside, 2 a text inside it, texts under 0.5 don't count; 3 is the entity alone.
    Its weight is the larger of the two, and 2.5 at most before group 3, so that another choice can take over; learned is
    0.5 or more. Then the one visited last is first."""
    days = 14 * 86_400.0
    q = F.lit(typed.lower())
    alone = decayed(visits, now, days, ["id"]).select("id", F.lit(3).alias("group"), "weight", "last")
    texts = decayed(visits.where("text IS NOT NULL"), now, days, ["id", "text"]).where("weight >= 0.5")
    group = F.when(F.col("text") == q, 0).when(F.contains("text", q), 1).when(F.contains(q, F.col("text")), 2)
    by_text = texts.withColumn("group", group).where("group IS NOT NULL").join(alone.select("id", F.col("weight").alias("_alone")), "id")
    by_text = by_text.select("id", "group", F.greatest("weight", "_alone").alias("weight"), "last")
    best = alone.unionByName(by_text).groupBy("id").agg(F.max(F.struct((-F.col("group")).alias("g"), "weight", "last")).alias("b"))
    best = best.select("id", (-F.col("b.g")).alias("group"), F.col("b.weight").alias("weight"), F.col("b.last").alias("last")).where("weight >= 0.5")
    scale = F.element_at(F.array(*map(F.lit, (40, 30, 24, 20))), F.col("group") + 1)
    bonus = F.round(scale * F.log2(1 + F.least("weight", F.lit(15.0)))).cast("int")
    counted = F.when(F.col("group") <= 2, F.least("weight", F.lit(2.5))).otherwise(F.col("weight"))
    rows = hits.join(best.select("id", "group", counted.alias("weight"), "last", bonus.alias("bonus")), "id", "left").withColumn("learned", F.col("group").isNotNull())
    rows = rows.withColumn("score", F.when(F.col("learned"), F.greatest(F.col("score"), 300 + F.col("bonus"))).otherwise(F.col("score")))
    plain = [F.when(~F.col("learned"), F.col(c)).desc_nulls_last() for c in ("score", "modified")]
    return rows.orderBy(F.desc("learned"), F.asc("group"), F.desc("weight"), F.desc("last"), *plain, "id").limit(limit).drop("group", "weight", "last", "bonus")
