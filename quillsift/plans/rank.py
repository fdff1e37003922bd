"""Relevance as a Column, and total orders for results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import text as T

from . import pinyin
from . import query as Q
from .query import PROGRAMS, Fields, Term, Way, fields


def _place(term: str, f: Fields) -> Column:
    """30 at the start, 18 at a word start, 4 elsewhere."""
    return F.when(F.startswith(f.name_folded, F.lit(term)), 30).when(f.name.rlike(T.word_start_regex(term)), 18).otherwise(4)


def _heard(term: Term, f: Fields) -> Column | None:
    """Where and how well a word that is not in the name sounds like it."""
    if f.sounds is None or term.exact or not pinyin.is_term(term.text):
        return None
    return F.when(~F.contains(f.name_folded, F.lit(term.text)), f.sounds.getItem(term.text))


def _points(term: Term, f: Fields) -> tuple[Column, Column]:
    """Points of a term, and the bytes of the name that it covers."""
    none, size = F.lit(0), F.lit(len(term.text.encode()))
    if term.kind in ("regex", "anchor"):
        return F.lit(20), none
    if term.kind == "glob":
        return F.lit(10), F.lit(len("".join(c for c in term.text if c not in "*?").encode()))
    if not term.text:
        return none, none
    inside = F.contains(f.name_folded, F.lit(term.text))
    points, covered = F.when(inside, _place(term.text, f)), F.when(inside, size)
    if (heard := _heard(term, f)) is not None:
        points, covered = points.when(heard.isNotNull(), heard["points"]), covered.when(heard.isNotNull(), heard["bytes"])
    if initials := T.initials_regex(term.text):
        program = ~f.is_dir & F.coalesce(f.ext.isin(PROGRAMS), F.lit(False)) & f.name.rlike(initials)
        points, covered = points.when(program, 12), covered.when(program, size)
    return points.otherwise(3), covered.otherwise(0)


def _whole(term: Term, f: Fields) -> Column:
    """60 for a name that is the word, 45 for one that is with an extension, 40 for one that sounds like it throughout."""
    stem = F.when(f.is_dir, f.name_folded).otherwise(T.stem(f.name_folded))
    out = F.when(f.name_folded == term.text, 60).when(stem == term.text, 45)
    if (heard := _heard(term, f)) is not None:
        out = out.when((heard["start"] == 0) & (heard["bytes"] >= F.octet_length(stem)), 40)
    return out.otherwise(0)


def score(ways: list[Way], f: Fields | None = None) -> Column:
    """Points of the best way: places of the terms, whole names, and how much of the name the terms cover (bytes)."""
    f, each = f or fields(), []
    for way in ways:
        parts = [_points(t, f) for t in way.positive]
        total, covered = (reduce(Column.__add__, [p[i] for p in parts], F.lit(0)) for i in (0, 1))
        if len(way.positive) == 1 and way.positive[0].kind == "word" and way.positive[0].text and not way.positive[0].ancestors:
            total = total + _whole(way.positive[0], f)
        length = F.greatest(F.octet_length(f.name_folded), F.lit(1))
        each.append((total + F.floor(F.least(covered, length) * 25 / length)).cast("int"))
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return best + F.when(f.is_dir, 2).otherwise(0)


def entry_score(points: Column, low: Column, hidden: Column, preferred: list[str], exact: Column) -> Column:
    """A name's points as its entry ranks: hidden entries lose 15 and those of low priority 35; files of preferred types
    gain 12, and the 35 back where they are named just what was typed; each level of depth takes one off, 12 at most."""
    liked = ~F.col("is_dir") & F.coalesce(F.col("ext").isin(preferred), F.lit(False))
    place = F.when(low & ~(liked & exact), -35).otherwise(0) - F.when(hidden, 15).otherwise(0) + F.when(liked, 12).otherwise(0)
    return (points + place - F.least("depth", F.lit(12))).cast("int")


def by_match(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), F.desc("modified"), F.asc("id"))


def by(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """One key either way, unknown values last in both, ties by id."""
    column = F.col(key)
    if key in ("modified", "created"):
        column = F.when(column >= 315_619_200, column)
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.asc("id"))


def top_of_each_kind(df: DataFrame, k: int) -> DataFrame:
    """The best k files and the best k folders."""
    order = Window.partitionBy("is_dir").orderBy(F.desc("score"), F.desc("modified"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def page(df: DataFrame, after: int | None, size: int) -> DataFrame:
    """Keyset pagination by id: the next `size` rows after an id."""
    return (df if after is None else df.where(F.col("id") > after)).orderBy("id").limit(size)


def within_bytes(df: DataFrame, column: Column, budget: int, by: str = "id") -> DataFrame:
    """Rows in order of a key until a budget of bytes is spent, with what is spent so far (_spent).

    Running sums are taken in pieces of the key and then over the pieces, so that no task sorts all rows.
    """
    cost = F.octet_length(column).cast("long")
    piece = F.floor(F.col(by) / 65536).alias("_piece")
    rows = df.select("*", piece, cost.alias("_cost"))
    sums = rows.groupBy("_piece").agg(F.sum("_cost").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_piece", before.alias("_before")).where(F.col("_before") < budget)
    inside = F.sum("_cost").over(Window.partitionBy("_piece").orderBy(by))
    return rows.join(starts, "_piece").withColumn("_spent", F.col("_before") + inside).where(F.col("_spent") <= budget).drop("_piece", "_cost", "_before")


def scored(entries: DataFrame, text: str, readings: DataFrame | None = None) -> DataFrame:
    """What a text finds with its score, and `approximate`: false. Where it finds nothing at all, and only then, its Han words
    are read as they sound, and each entry has the best score of the readings that find it, as approximate."""
    ways = Q.parse(text)

    def found(some: list[list[Way]]) -> DataFrame:
        rows = Q.heard(entries, [w for ways in some for w in ways], readings)
        f = fields(sounds="sounds" in rows.columns)
        each = [F.when(Q.predicate(w, f), score(w, f)) for w in some]
        return rows.withColumn("score", F.greatest(*each) if len(each) > 1 else each[0]).where("score IS NOT NULL").select(*entries.columns, "score")

    first = found([ways])
    if readings is None or not first.isEmpty():
        return first.withColumn("approximate", F.lit(False))
    second = Q.homophones(text, readings)
    if not second:
        return first.withColumn("approximate", F.lit(False))
    return found(second).withColumn("approximate", F.lit(True))


def answer(df: DataFrame, after: int | None, size: int) -> DataFrame:
    """A page of rows by id with `next_cursor`, the id to go on after, and `truncated`, both the same on all rows of the page:
    one row more is read than is given."""
    more = page(df, after, size + 1).withColumn("_n", F.row_number().over(Window.orderBy("id")))  # size + 1 rows at most
    told = more.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size)
    return told.withColumn("next_cursor", F.when(F.col("truncated"), F.max("id").over(Window.partitionBy()))).drop("_n")
